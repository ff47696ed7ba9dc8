"""Personal data by weak supervision: labelers vote on candidate spans, expectation-maximisation estimates how far each can be
trusted, and a span classifier learnt from what they say together decides which candidates are added to the plain matches.

Candidates are the plain matches and what these miss: addresses written out, numbers whose plain match swallowed a neighbour and
so failed its own test, national telephone numbers, eight-part addresses. What is gathered from the corpus is a count of each
(kind, votes, shape), whatever its size at most 4 * 3**6 * 2**7 numbers; both passes over the texts are narrow.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, insort

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, lean

#: Fixed: kinds, in the order that breaks ties of place.
KINDS = ("email", "ip", "card", "phone")
#: Fixed: what an address before its @ is made of, and a domain. A run is taken whole, so nothing is tried twice.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
FOUR = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
NUMBER = re.compile(r"[0-9]++(?:[\x20-][0-9]++)*+")
PLUS = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_digit = re.compile(r"[0-9]").search
_bare = re.compile(r"[^0-9]+").sub

#: Labelers of each kind: two of shape, two of lists, two of context.
LABELERS = {
    "email": ("whole shape", "clean ends", "known ending", "mail host", "words before", "signs around"),
    "ip": ("whole shape", "plain parts", "public range", "long run", "words before", "signs around"),
    "card": ("grouping", "length", "issuer", "repeats", "words before", "signs around"),
    "phone": ("written shape", "not a date", "country code", "area code", "words before", "signs around"),
}
NAMES_BEFORE = {
    "email": ("mail", "contact", "kontakt", "correo", "courriel", "contacto", "write to", "from", "reply"),
    "ip": ("ip", "ips", "address", "adresse", "dirección", "host", "client", "server", "login"),
    "card": ("card", "visa", "credit", "karte", "kreditkarte", "carte", "tarjeta", "payment", "mastercard", "amex", "cc"),
    "phone": ("tel", "phone", "call", "fax", "mobile", "cell", "telefon", "mobil", "handy", "téléphone", "portable", "teléfono", "móvil", "llame"),
}
OTHERS_BEFORE = {
    "email": ("git", "ssh", "scp", "clone", "ftp"),
    "ip": ("version", "ver", "release", "section", "chapter", "firmware", "build", "kapitel", "abschnitt", "chapitre", "sección"),
    "card": ("isbn", "order", "invoice", "tracking", "serial", "ean", "imei", "ticket", "rechnung", "bestellung", "commande", "pedido"),
    "phone": ("isbn", "issn", "order", "invoice", "page", "pages", "vol", "version", "pp", "id", "rechnung", "seite", "commande", "pedido"),
}
#: Endings of domains that people's addresses have, and endings of files that look like them.
ENDINGS = frozenset("com org net edu gov mil int info biz io co me ai app dev eu de at ch fr be es mx ar cl uk ie us ca au nz nl se no dk fi pl it pt br ru in jp cn kr".split())
FILES = frozenset("png jpg jpeg gif svg webp css js py html htm php json xml txt md pdf zip".split())
#: Country calling codes of the world's zones, by their first digits.
CODES = re.compile(r"1|7|20|2[17]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|2[1-69][0-9]|3[578][0-9]|42[013]|5[09][0-9]|6[789][0-9]|8[058][0-9]|9[679][0-9]")
#: Twice a digit, its own digits added up.
DOUBLED = str.maketrans("0123456789", "0246813579")
#: No card's number is written in more groups than this.
MOST_GROUPS = 5
#: Issuers by leading digits and lengths.
ISSUERS = ((re.compile("4"), (13, 16, 19)), (re.compile("5[1-5]|222[1-9]|22[3-9]|2[3-6]|27[01]|2720"), (16,)), (re.compile("3[47]"), (15,)), (re.compile("3(?:0[0-5]|[689])"), (14,)), (re.compile("6011|64[4-9]|65|35(?:2[89]|[3-8])|62"), (16, 17, 18, 19)))
GROUPINGS = frozenset(((13,), (14,), (15,), (16,), (19,), (4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 4, 4, 4, 3)))
_obscured = re.compile(r"(?<=[A-Za-z0-9])\x20?(?:@|[\[({<](?:at|AT)[\])}>])\x20?(?=[A-Za-z0-9])|(?<=[A-Za-z0-9])\x20(?:at|AT)\x20(?=[A-Za-z0-9-]+\x20(?:dot|DOT)\x20)")
WRITTEN = ("@", "at]", "at)", "at}", "at>", "AT]", "AT)", "AT}", "AT>", " dot ", " DOT ")
_far = re.compile(r"[A-Za-z0-9-]++(?:(?:\.|\x20?[\[({<](?:dot|DOT)[\])}>]\x20?|\x20(?:dot|DOT)\x20)[A-Za-z0-9-]++)*+")
_dot = re.compile(r"\x20?[\[({<](?:dot|DOT)[\])}>]\x20?|\x20(?:dot|DOT)\x20|\.")
_eight = re.compile(r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Za-z:])")
_dotted = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){4,}+")
_national = re.compile(r"(?<![0-9A-Za-z.+(/-])(?:00[1-9][0-9]{0,2}[\x20.-]?)?(?:\([0-9]{2,4}\)[\x20.-]?|[0-9]{2,5}[\x20./-])[0-9]{2,4}(?:[\x20.-][0-9]{2,4}){0,4}(?![0-9A-Za-z])")
_groups = re.compile(r"[0-9]+").finditer
_american = re.compile(r"(?:(?:\+|00)?1[\x20.-]?)?(?:\(([0-9]{3})\)[\x20.-]?|([0-9]{3})[\x20.-])([0-9]{3})[\x20.-]([0-9]{4})")
_date = re.compile(r"(?:1[6-9]|20)[0-9]{2}[./-][0-9]{1,2}[./-][0-9]{1,2}|[0-9]{1,2}[./-][0-9]{1,2}[./-](?:1[6-9]|20)?[0-9]{2}|(?:1[6-9]|20)[0-9]{2}[\x20-](?:1[6-9]|20)[0-9]{2}")
_word = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    """Whether a number's check digit is right."""
    return (sum(map(int, digits[::-2])) + sum(map(int, digits[-2::-2].translate(DOUBLED)))) % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            done = m.end()
            out.append((start, done))
        at = text.find("@", max(at + 1, done))
    return out


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the plain matches: leftmost, not overlapping within a kind; matches that fail their test are dropped and not tried again."""
    out = [(0, a, b) for a, b in _emails(text)]
    if _digit(text):
        out += [(1, m.start(), m.end()) for m in FOUR.finditer(text) if all(map(_small, m.group().split(".")))]
        for m in NUMBER.finditer(text):
            if 14 <= m.end() - m.start() and 14 <= len(n := _bare("", m.group())) <= 19 and luhn(n):
                out.append((2, m.start(), m.end()))
        out += [(3, m.start(), m.end()) for m in PLUS.finditer(text) if 10 <= len(_bare("", m.group())) <= 15]
    return out


def _wider(text: str):
    """(kind, start, end) of what plain matches can miss."""
    if any(x in text for x in WRITTEN):
        for m in _obscured.finditer(text):
            start = m.start()
            while start and text[start - 1] in LOCAL:
                start -= 1
            far = _far.match(text, m.end())
            if start < m.start() and far:
                yield 0, start, far.end()
    if not _digit(text):
        return
    for m in _eight.finditer(text):
        yield 1, m.start(), m.end()
    for m in _dotted.finditer(text):
        parts = list(_groups(text, m.start(), m.end()))
        for k in range(len(parts) - 3):
            if all(_small(p.group()) for p in parts[k : k + 4]):
                yield 1, parts[k].start(), parts[k + 3].end()
    for m in NUMBER.finditer(text):
        if m.end() - m.start() < 13:
            continue
        parts = list(_groups(text, m.start(), m.end()))
        for k, first in enumerate(parts):
            digits = ""
            for p in parts[k : k + MOST_GROUPS]:
                digits += p.group()
                if len(digits) > 19:
                    break
                if len(digits) >= 13 and luhn(digits):
                    yield 2, first.start(), p.end()
    for m in PLUS.finditer(text):
        n = 0
        for p in _groups(text, m.start(), m.end()):
            n += p.end() - p.start()
            if n > 15:
                break
            if n >= 8:
                yield 3, m.start(), p.end()
    for m in _national.finditer(text):
        if 7 <= len(_bare("", m.group())) <= 15:
            yield 3, m.start(), m.end()


def _words_before(kind: str, text: str, start: int) -> int:
    """1 where one of the last words before names the kind, 2 where it names another thing."""
    last = _word.findall(text[max(0, start - 32) : start].lower())[-3:]
    return 1 if any(w in NAMES_BEFORE[kind] for w in last) else 2 if any(w in OTHERS_BEFORE[kind] for w in last) else 0


def votes(kind: int, text: str, start: int, end: int) -> tuple[int, ...]:
    """What each labeler of the kind says of a span: 0 nothing, 1 yes, 2 no."""
    span, name = text[start:end], KINDS[kind]
    before, after = text[start - 1 : start], text[end : end + 1]
    said = _words_before(name, text, start)
    if name == "email":
        m = _obscured.search(span)
        local, host = (span[: m.start()], _dot.split(span[m.end() :])) if m else (span.rsplit("@", 1)[0], span.rsplit("@", 1)[-1].split("."))
        ending = host[-1].lower()
        shape = 1 if len(host) > 1 and ending.isalpha() and len(ending) > 1 else 2
        ends = 2 if not local or local[0] in ".-%+" or local[-1] in ".-%+" or ".." in local or any(not h or h[0] == "-" or h[-1] == "-" for h in host) else 1
        known = 1 if len(host) > 1 and ending in ENDINGS else 2 if ending in FILES or len(host) < 2 else 0
        mail = 1 if re.match(r"(?:g|e|web|hot|proto?n?)?mail|posteo|outlook|yahoo|gmx|icloud", host[0].lower()) else 0
        around = 2 if before in ("/", ":", "@") or after == "@" or (after == ":" and text[end + 1 : end + 2].strip()) else 1 if not before.isalnum() and not after.isalnum() else 0
        return shape, ends, known, mail, said, around
    if name == "ip":
        if ":" in span:
            parts = span.split(":")
            return 1, 1 if any(len(p) > 2 for p in parts) else 2, 1 if parts[0][:1] in "23f" else 0, 1, said, 2 if before.isalnum() or after.isalnum() else 1
        parts = span.split(".")
        run = (before == "." and text[start - 2 : start - 1].isdigit()) or (after == "." and text[end + 1 : end + 2].isdigit())
        shape = 1 if all(map(_small, parts)) and not run else 2
        plain = 2 if any(len(p) > 1 and p[0] == "0" for p in parts) or max(map(len, parts)) == 1 else 1
        return shape, plain, 1 if 1 <= int(parts[0][:4]) <= 223 and parts[0] != "127" else 2, 2 if run else 0, said, 2 if before.isalpha() or after.isalpha() or before in ("-", "/") else 1
    groups = tuple(len(g.group()) for g in _groups(span))
    digits = _bare("", span)
    if name == "card":
        n = len(digits)
        grouping = 1 if groups in GROUPINGS else 2
        issuer = 1 if any(n in sizes and lead.match(digits) for lead, sizes in ISSUERS) else 2
        alike = 2 if len(set(digits)) < 4 else 1
        around = 2 if before.isalnum() or after.isalnum() or before in ("_", ".", "+") or (after == "." and text[end + 1 : end + 2].isdigit()) else 1
        return grouping, 1 if n in (15, 16) else 0 if n in (13, 14, 19) else 2, issuer, alike, said, around
    american = _american.fullmatch(span)
    abroad = span[:1] == "+" or span[:2] == "00"
    shape = 1 if american or (abroad and 3 <= len(groups) <= 6) or (span[:1] in "(0" and 9 <= len(digits) <= 12) else 2 if not abroad and (max(groups) < 3 or len(digits) < 9) else 0
    date = 2 if _date.fullmatch(span) or (not abroad and len(set(groups)) == 1 and len(groups) > 3) else 1 if abroad or american else 0
    code = (1 if CODES.match(digits[2:] if span[:2] == "00" else digits) else 2) if abroad else 0
    area = (1 if (american.group(1) or american.group(2))[0] > "1" and american.group(3)[0] > "1" else 2) if american else 0
    around = 2 if before.isalnum() or after.isalnum() or before in ("_", "$", "€", "#", "=") or after in ("%", "€") or (after in (".", "-", ",", "/") and text[end + 1 : end + 2].isdigit()) else 1
    return shape, date, code, area, said, around


def shape(text: str, start: int, end: int) -> int:
    """Seven yes-or-no features of a span and its neighbours, as bits."""
    span = text[start:end]
    before, after = text[start - 1 : start], text[end : end + 1]
    marks = (" " in span, "-" in span, "." in span, "(" in span or "[" in span, end - start > 17, before in ("", " ", "\n", "\t"), after in ("", " ", "\n", "\t", ".", ","))
    return sum(int(x) << k for k, x in enumerate(marks))


BITS = 7


def candidates(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(plain matches, other spans that could be added): the latter overlap no plain match."""
    base = base_spans(text)
    taken = sorted((a, b) for _, a, b in base)
    # of all that begin before a place, the furthest end so far
    reach, far = [], -1
    for _, b in taken:
        far = max(far, b)
        reach.append(far)
    others = []
    for c in sorted(set(_wider(text))):
        k = bisect_left(taken, (c[2],))
        if not k or reach[k - 1] <= c[1]:
            others.append(c)
    return base, others


def _cell(kind: int, text: str, start: int, end: int) -> tuple[int, int, int]:
    code = 0
    for v in votes(kind, text, start, end):
        code = 3 * code + v
    return kind, code, shape(text, start, end)


def _unpack(code: int, n: int) -> list[int]:
    out = []
    for _ in range(n):
        out.append(code % 3)
        code //= 3
    return out[::-1]


def cells(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(kind, votes, shape, n): how often labelers vote so on a span so shaped, over all candidates of all texts."""

    def run(batches):
        from collections import Counter

        import pyarrow as pa

        c = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                if text:
                    for spans in candidates(text):
                        c.update(_cell(*s[:1], text, *s[1:]) for s in spans)
        cols = list(zip(*c, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.int32()) for x in cols] + [pa.array(list(c.values()), pa.int64())], ["kind", "votes", "shape", "n"])

    bound_batches(docs.sparkSession)
    counted = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(lean(run), "kind int, votes int, shape int, n long")
    return counted.groupBy("kind", "votes", "shape").agg(F.sum("n").alias("n"))


#: Before any data a labeler counts as right in three of four cases that it judges, by so many made-up votes; and half of all candidates as true.
BELIEF, RIGHT = 8.0, 0.75


def reliabilities(patterns, counts, rounds: int = 500, near: float = 1e-10):
    """(prior, tables, posterior of each pattern) by expectation-maximisation.

    patterns: rows of votes (0 none, 1 yes, 2 no), counts: how often each. tables[l, y, v]: chance that labeler l says v of a
    span that is (y = 1) or isn't. Labelers are taken as independent given the truth. The start is the share of yes votes; the
    belief keeps yes from changing its meaning, and stands for a table without candidates.
    """
    import numpy as np

    patterns, counts = np.asarray(patterns, int), np.asarray(counts, float)
    n = patterns.shape[1]
    yes, no = (patterns == 1).sum(1), (patterns == 2).sum(1)
    posterior = (1 + yes) / (2.0 + yes + no)
    made = np.full((n, 2, 3), BELIEF / 2)
    made[:, 1, 1] = made[:, 0, 2] = BELIEF * RIGHT
    made[:, 1, 2] = made[:, 0, 1] = BELIEF * (1 - RIGHT)
    said = np.stack([(patterns == v) for v in range(3)], 2).astype(float)
    for _ in range(rounds):
        weight = np.stack([1 - posterior, posterior], 1) * counts[:, None]
        tables = np.einsum("py,plv->lyv", weight, said) + made
        tables /= tables.sum(2, keepdims=True)
        prior = (weight[:, 1].sum() + BELIEF / 2) / (counts.sum() + BELIEF)
        log = np.einsum("plv,lyv->py", said, np.log(tables)) + np.log([1 - prior, prior])
        new = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -500, 500)))
        moved = np.abs(new - posterior).max() if len(new) else 0.0
        posterior = new
        if moved < near:
            break
    return prior, tables, posterior


def _inputs(codes, shapes, n: int):
    """A row for each cell: one, each labeler's yes and no, each bit of the shape."""
    import numpy as np

    said = np.array([_unpack(c, n) for c in codes], int).reshape(-1, n)
    bits = (np.asarray(shapes, int)[:, None] >> np.arange(BITS)) & 1
    return np.hstack([np.ones((len(said), 1)), said == 1, said == 2, bits]).astype(float)


def _logistic(x, y, weight, ridge: float = 1.0, rounds: int = 100):
    """Weights of a logistic model of probabilities y, by Newton's method with a ridge on all but the constant."""
    import numpy as np

    w, keep = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    keep[0] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + np.diag(keep), x.T @ (weight * (y - p)) - keep * w)
        w += step * min(1.0, 4.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_personal(docs: DataFrame, text_col: str = "text") -> list[list[float]]:
    """The span classifier's weights, a list a kind, from the votes on all candidates of all texts.

    Only the counts by (kind, votes, shape) come to the driver: at most 4 * 3**6 * 2**7, however many texts there are. Equal
    counts give equal weights, so the order of rows and partitions changes nothing. Without candidates the labelers' assumed
    reliability speaks.
    """
    import numpy as np

    found = sorted(tuple(r) for r in cells(docs, text_col).collect())
    out = []
    for k, name in enumerate(KINDS):
        n = len(LABELERS[name])
        own = [r for r in found if r[0] == k]
        # one made-up span of each unanimous vote stands beside the corpus's
        codes = [r[1] for r in own] + [int("1" * n, 3), int("2" * n, 3)]
        shapes, counts = [r[2] for r in own] + [0, 0], np.array([r[3] for r in own] + [1, 1], float)
        *_, posterior = reliabilities([_unpack(c, n) for c in codes], counts)
        # counts weigh by their roots: a shape seen a million times shall not outvote all that is rare
        out.append(_logistic(_inputs(codes, shapes, n), posterior, np.sqrt(counts)).tolist())
    return out


def _score(weights, cell) -> float:
    w, (kind, code, bits) = weights[cell[0]], cell
    n = len(LABELERS[KINDS[kind]])
    z = w[0]
    for k, v in enumerate(_unpack(code, n)):
        z += (0.0, w[1 + k], w[1 + n + k])[v]
    z += sum(w[1 + 2 * n + k] for k in range(BITS) if bits >> k & 1)
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def find_spans(text: str, weights, least: float = 0.5) -> list[tuple[int, int, int, bool, float]]:
    """(kind, start, end, plain match or not, score) by start, then kind: all plain matches, and of the other candidates that
    score least or more, the best first, those that overlap none before them; of equal scores the earlier, then the longer, then the kind listed first."""
    base, others = candidates(text)
    out = [(*s, True, _score(weights, _cell(s[0], text, *s[1:]))) for s in base]
    scored = ((_score(weights, _cell(s[0], text, *s[1:])), s) for s in others)
    taken: list[tuple[int, int]] = []
    for score, s in sorted((x for x in scored if x[0] >= least), key=lambda x: (-x[0], x[1][1], -x[1][2], x[1][0])):
        at = bisect_left(taken, (s[1], s[2]))
        if (at == 0 or taken[at - 1][1] <= s[1]) and (at == len(taken) or taken[at][0] >= s[2]):
            insort(taken, (s[1], s[2]))
            out.append((*s, False, score))
    return sorted(out, key=lambda x: (x[1], x[0], x[2]))


SPAN = T.StructType().add("kind", "string").add("start", "long").add("end", "long").add("plain", "boolean").add("score", "double")


def personal_data(docs: DataFrame, weights: list[list[float]], id_col: str = "doc_id", text_col: str = "text", least: float = 0.5, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, found array of (kind, start, end, plain, score), redacted[, keep]) for each row.

    Places are code points, the end exclusive; found goes by start, then kind. plain marks the plain matches, which always
    stay; others are added by the classifier. redacted is the text with each run of overlapping spans replaced by its
    kinds in angle brackets. A null text counts as empty: no spans, an empty redacted text. Repeated rows give repeated results, null ids stay
    null, other columns are ignored but for keep, which must not have the names made here. An empty table gives an empty one. A
    narrow map: a batch of about 2 MB, or one row, in memory.
    """
    clash = set(keep) & {id_col, "found", "redacted"}
    if clash:
        raise ValueError(f"names made here: {sorted(clash)}")
    bound_batches(docs.sparkSession)
    out = T.StructType([docs.schema[id_col]]).add("found", T.ArrayType(SPAN)).add("redacted", "string")
    for c in keep:
        out = out.add(docs.schema[c])

    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("plain", pa.bool_()), ("score", pa.float64())]))
        for batch in batches:
            found, redacted = [], []
            for text in batch.column("__text").to_pylist():
                spans = find_spans(text, weights, least) if text else []
                found.append([{"kind": KINDS[k], "start": a, "end": b, "plain": p, "score": s} for k, a, b, p, s in spans])
                redacted.append(redact(text or "", [(KINDS[k], a, b) for k, a, b, _, _ in spans]))
            cols = [batch.column("__id"), pa.array(found, kind), pa.array(redacted, pa.string()), *(batch.column(f"__k{k}") for k in range(len(keep)))]
            yield pa.RecordBatch.from_arrays(cols, [f.name for f in out])

    return docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"), *[F.col(c).alias(f"__k{k}") for k, c in enumerate(keep)]).mapInArrow(lean(run), out)


def redact(text: str, spans) -> str:
    """text with each run of overlapping (kind, start, end) replaced by its kinds in angle brackets."""
    out, done, kinds, at = [], 0, [], None
    for kind, a, b in [*spans, ("", len(text) + 1, 0)]:
        if at is not None and a < done:
            kinds += [kind] * (kind not in kinds)
            done = max(done, b)
            continue
        if at is not None:
            out.append("<" + "/".join(kinds) + ">")
        out.append(text[done:a])
        at, done, kinds = a, b, [kind]
    return "".join(out)
