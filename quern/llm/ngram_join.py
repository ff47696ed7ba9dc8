"""N-gram Jaccard join by token-combination prefixes.

A document is the set of its distinct shingles. All shingles are put in one order: rare ones first, then the frequent
ones by classes of growing frequency. A set a that links has at most t = n - ceil(percent n) shingles that its partner
lacks. Its prefix is extended until its signatures survive the loss of any t shingles: a rare shingle is a signature of
its own, and loses one of them; frequent shingles are dealt over bins, and the combinations of two within a bin are
signatures, so a bin of s shingles still holds a common combination after the loss of s - 2. Therefore a prefix of r rare
and s[i] frequent shingles of bin i is long enough as soon as r + sum(max(0, s[i] - 1)) > t. The prefix of one of two linked
sets that ends first in the order is, but for at most t shingles, part of the other's, so both hold a common signature.
The number of bins follows the size of the smaller set of a pair (in powers of two, so a set near the next power has the
signatures of two numbers of bins); it keeps a prefix's combinations within about twice its shingles.

Signatures of few sets give candidates, which positions filter: common rare shingles, and the rare ones that no other
prefix holds, bound the intersection. Signatures of many sets whose sets links haven't joined yet are groups that are compared
within, block against block, as products of matrices; signatures of the same near copies go as one group. So no link
between components is missed, no group is ever in one place, and pairs that don't link are no rows. Equal sets are joined
first, and only one of them goes on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, components, drop, lean, lists, stash, text_bytes, window_hashes, word_hashes, word_table

SHINGLE = 4
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 85
#: Shingles in more sets than this are frequent, if no more than MOST_FREQUENT are; else the limit is doubled.
FREQUENT, MOST_FREQUENT = 32, 2_000_000
#: How far shingles are counted to find the frequent ones, in quarters of a prefix; sets that hold so many of these that a prefix goes on are counted whole.
REACH = 5
#: Of signatures in more sets than this not all pairs are candidates; their sets are compared in blocks.
SINGLE = 32
#: Sets of a large group that one block holds, about, and shingles of them all; shingles that are counted at once.
BLOCK, BLOCK_SHINGLES, COLUMNS = 256, 1_000_000, 4096


def shingle_sets(batch, name: str, size: int = SHINGLE) -> list:
    """For each text sorted distinct 64-bit hashes of its shingles; a shorter text is one shingle, one without words none."""
    import numpy as np

    bare, at, first = word_table(*text_bytes(batch, name), lower=True)
    codes = word_hashes(bare, at)
    windows = window_hashes(codes, size)
    out = []
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if hi - lo >= size:
            found = windows[lo : hi - size + 1]
        else:
            found = window_hashes(codes[lo:hi], hi - lo) + np.uint64(hi - lo) if hi > lo else codes[:0]
        found = np.sort(found.view(np.int64))
        out.append(found[np.r_[True, found[1:] != found[:-1]]] if len(found) else found)
    return out


def missing(n: int, percent: int) -> int:
    """How many shingles of a set its partner may lack."""
    return n - -(-percent * n // 100)


def reach(n: int, percent: int) -> int:
    return min(n, REACH * (missing(n, percent) + 1) // 4 + 1)


def schemes(n: int, percent: int) -> list[int]:
    """Exponents of the powers of two up to the size of this set and of the smallest that it may link with."""
    own, least = n.bit_length() - 1, (-(-percent * n // 100)).bit_length() - 1
    return list(range(own, least - 1, -1))


def bins(scheme: int) -> int:
    return max(1, 2**scheme // 8)


def _mix(x):
    import numpy as np

    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def combinations(often, scheme: int, need: int):
    """(how many of these shingles, in order, the prefix takes to cover need losses; a hash of each combination of two in a bin)."""
    import numpy as np

    h = _mix(often.view(np.uint64))
    own = (h % np.uint64(bins(scheme))).astype(np.int64)
    order = np.argsort(own, kind="stable")
    sorted_bins = own[order]
    starts = np.flatnonzero(np.r_[True, sorted_bins[1:] != sorted_bins[:-1]])
    rank = np.empty(len(own), np.int64)
    rank[order] = np.arange(len(own)) - np.repeat(starts, np.diff(np.r_[starts, len(own)]))
    covered = np.cumsum(rank > 0)
    p = int(np.searchsorted(covered, need)) + 1  # the first place where need are covered; beyond the end only for sets that link with equal ones alone
    p = min(p, len(own))
    order = order[order < p]  # still by bin, and in order within
    key, b = h[order], own[order]
    found, step = [], 1
    while step < p and (same := b[step:] == b[:-step]).any():
        found.append(_mix(key[:-step][same] * np.uint64(0x9E3779B97F4A7C15) + _mix(key[step:][same] + np.uint64(scheme))))
        step += 1
    return p, np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)


def signatures(found, known, grade, percent: int):
    """(length of the prefix, rare shingles in it, combinations of the frequent ones in it) of a set; known: the frequent shingles, sorted, and their classes."""
    import numpy as np

    n = len(found)
    if len(known):
        at = np.minimum(np.searchsorted(known, found), len(known) - 1)
        last = known[at] == found
    else:
        last = np.zeros(n, bool)
    rare = found[~last]
    need = missing(n, percent) + 1 - len(rare)
    if need <= 0:
        rare = rare[: missing(n, percent) + 1]
        return len(rare), rare, found[:0]
    often = found[last]
    often = often[np.lexsort((often, grade[at[last]]))]
    made = [combinations(often, z, need) for z in schemes(n, percent)]
    return len(rare) + made[0][0], rare, np.concatenate([c for _, c in made])


def _fingerprint(found) -> tuple[int, int]:
    import hashlib

    digest = hashlib.blake2b(found.tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _mapped(docs: DataFrame, make, schema: str, size: int) -> DataFrame:
    """A row for each text, of the id and what make(set) gives; rows for which it gives None are left out."""
    key = docs.schema["id"].dataType.simpleString()
    names = ["id", *(c.split()[0] for c in schema.split(", "))]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            made = [make(s) for s in shingle_sets(batch, "text", size)]
            at = [k for k, m in enumerate(made) if m is not None]
            if at:
                cols = zip(*(made[k] for k in at), strict=True)
                arrays = [lists(c) if hasattr(c[0], "dtype") else pa.array(c, pa.int64()) for c in cols]
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at)), *arrays], names)

    return docs.select("id", "text").mapInArrow(lean(run), f"id {key}, {schema}")


def _verified(docs: DataFrame, pairs: DataFrame, percent: int, size: int) -> DataFrame:
    """The pairs (a, b) that link, by their whole sets; only the texts of these pairs are read."""
    nodes = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    sets = stash(_mapped(docs.join(nodes, "id", "left_semi"), lambda s: (s,) if len(s) else None, "set array<long>", size), "whole", tidy=True)
    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b")
    same = F.size(F.array_intersect("sa", "sb"))
    out = stash(both.where(100 * same >= percent * (F.size("sa") + F.size("sb") - same)).select("a", "b").distinct(), "linked", tidy=True)
    drop(sets)
    return out


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """(id, n_shingles, component_id) for each row.

    Null and empty texts have empty sets and link with nothing. Rows that repeat an id are one node, whatever their
    texts. A null id links with nothing and has a null component. Ids are of any type that Spark orders. Extra columns
    are ignored; an empty table gives an empty result. percent is over 50.
    """
    if not 50 < percent <= 100:
        raise ValueError("percent is over 50 and at most 100")
    bound_batches(docs.sparkSession)
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    heads = stash(_mapped(d, lambda s: (len(s), *_fingerprint(s), s[: reach(len(s), percent)]), "n long, f1 long, f2 long, head array<long>", size), "heads")
    base = stash(heads.select("id", "n", "f1", "f2"), "sets")
    some = base.where((F.col("n") > 0) & F.col("id").isNotNull())
    reps = stash(some.groupBy("f1", "f2").agg(F.min("id").alias("rep")), "distinct")
    links = _links(d, heads, reps.select(F.col("rep").alias("id"), "f1", "f2"), percent, size)
    # an id of several sets ties their classes
    several = some.groupBy("id").agg(F.min("f1").alias("lo"), F.max("f1").alias("hi")).where(F.col("lo") != F.col("hi")).select("id")
    ties = some.join(several, "id", "left_semi").join(reps, ["f1", "f2"]).select(F.col("rep").alias("a"), F.col("id").alias("b"))
    comps = components(links.unionAll(ties)).select(F.col("node").alias("rep"), "component")
    named = reps.join(comps, "rep", "left").select(F.col("f1").alias("g1"), F.col("f2").alias("g2"), F.coalesce("component", "rep").alias("root"))
    # a hot class has many rows on the left and one on the right: Spark splits it
    rows = base.join(named, (F.col("f1") == F.col("g1")) & (F.col("f2") == F.col("g2")) & F.col("id").isNotNull(), "left")
    return rows.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("root", "id")).otherwise(F.col("id")).alias("component_id"))


def _frequent(docs: DataFrame, heads: DataFrame, reps: DataFrame, percent: int, size: int):
    """(frequent shingles, sorted; the class of each): broadcast, MOST_FREQUENT at most."""
    import numpy as np

    spark, key = docs.sparkSession, ["id", "f1", "f2"]
    counted = lambda rows: rows.groupBy("token").agg(F.count("*").alias("c")).where(F.col("c") > FREQUENT)
    tallies = [stash(counted(heads.where(F.size("head") > 0).join(reps, key, "left_semi").select(F.explode("head").alias("token"))), "frequent", tidy=True)]

    def listed():
        every = tallies[0]
        for t in tallies[1:]:
            every = every.unionAll(t)
        every = every.groupBy("token").agg(F.max("c").alias("c"))
        limit = FREQUENT
        while every.where(F.col("c") > limit).count() > MOST_FREQUENT:
            limit *= 2
        table = every.where(F.col("c") > limit).toArrow()
        token, c = table.column("token").to_numpy(), table.column("c").to_numpy()
        order = np.argsort(token)
        return spark.sparkContext.broadcast((token[order], np.frexp(c[order])[1].astype(np.uint8)))

    first = listed()

    def rest(s):
        """A set whose prefix passes what was counted, whole."""
        known, n = first.value[0], len(s)
        if not n or not len(known):
            return None
        h = reach(n, percent)
        at = np.minimum(np.searchsorted(known, s[:h]), len(known) - 1)
        return (*_fingerprint(s), s) if h < n and h - int((known[at] == s[:h]).sum()) <= missing(n, percent) else None

    if not len(first.value[0]):
        return first
    heavy = _mapped(docs, rest, "f1 long, f2 long, set array<long>", size).join(reps, key, "left_semi")
    tallies.append(stash(counted(heavy.select(F.explode("set").alias("token"))), "frequent", tidy=True))
    return listed()


def _links(docs: DataFrame, heads: DataFrame, reps: DataFrame, percent: int, size: int) -> DataFrame:
    """(a, b): enough of the links between different sets that their components are those of all links."""
    frequent = _frequent(docs, heads, reps, percent, size)
    drop(heads)

    def prefix(s):
        if not len(s):
            return None
        p, rare, two = signatures(s, *frequent.value, percent)
        return (*_fingerprint(s), len(s), p, rare, two)

    made = _mapped(docs, prefix, "f1 long, f2 long, n long, p long, rare array<long>, two array<long>", size)
    made = stash(made.join(reps, ["id", "f1", "f2"], "left_semi").select("id", "n", "p", F.size("rare").alias("r"), "rare", "two"), "prefixes", tidy=True)
    each = lambda c, two: made.select("id", "n", "p", "r", F.explode(c).alias("key"), F.lit(two).alias("two"))
    index = each("rare", False).unionAll(each("two", True))
    # a signature's first centre has the fewest rare shingles for its size
    centre = F.min(F.struct(F.floor(1000 * F.col("r") / F.col("n")), F.col("id"), F.col("n"))).alias("centre")
    shared = stash(index.groupBy("key").agg(F.count("*").alias("c"), centre).where(F.col("c") > 1), "shared", tidy=True)
    index = kept = stash(index.join(shared, "key"), "index", tidy=True)
    drop(made)
    drop(shared)

    # u: rare shingles that no other prefix holds; f: shingles of the prefix that candidates' common ones aren't counted by
    of = index.where(~F.col("two")).groupBy("id").agg(F.count("*").alias("held"), F.count_if(F.col("c") > SINGLE).alias("many"))
    index = index.join(of, "id", "left")
    index = index.withColumn("u", F.col("r") - F.coalesce("held", F.lit(0))).withColumn("f", F.col("p") - F.col("r") + F.coalesce("many", F.lit(0)))
    small, large = index.where(F.col("c") <= SINGLE), index.where(F.col("c") > SINGLE)
    large = stash(large.select("key", "two", "id", "n", "u", F.col("centre")["id"].alias("first"), F.col("centre")["n"].alias("fn")), "large")

    # 1. Candidates of signatures of few sets.
    side = lambda which, x: small.where(F.col("two") == which).select("key", *[F.col(c).alias(c + x) for c in ("id", "n", "p", "u", "f")])
    fits = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)
    both = lambda which: side(which, "a").join(side(which, "b"), "key").where((F.col("ida") < F.col("idb")) & fits(F.col("na"), F.col("nb")))
    least = F.ceil(percent * (F.col("na") + F.col("nb")) / (100 + percent) - 1e-9)  # the smallest intersection of linked sets
    wanted = F.greatest(F.lit(1), least - F.greatest(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) - F.least("fa", "fb"))
    alone = both(False).groupBy("ida", "idb").agg(F.count("*").alias("s"), F.min(wanted).alias("wanted")).where(F.col("s") >= F.col("wanted"))
    # sets with combinations have all their rare shingles in their prefixes
    reachable = lambda: F.least(F.col("na") - F.col("ua"), F.col("nb") - F.col("ub")) >= least
    pairs = alone.select("ida", "idb").unionAll(both(True).where(reachable()).select("ida", "idb"))
    star = large.where((F.col("id") != F.col("first")) & fits(F.col("n"), F.col("fn"))).select(F.least("id", "first").alias("ida"), F.greatest("id", "first").alias("idb"))
    pairs = stash(pairs.unionAll(star).distinct().select(F.col("ida").alias("a"), F.col("idb").alias("b")), "pairs", tidy=True)
    linked = _verified(docs, pairs, percent, size)
    drop(pairs)
    drop(kept)

    # 2. Signatures of many sets whose components still differ.
    comps = stash(components(linked), "parts", tidy=True)
    drop(linked)
    placed = large.join(comps.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    of = placed.groupBy("key").agg(F.min("n").alias("least_n"), F.min("component").alias("lo"), F.max("component").alias("hi")).where(F.col("lo") != F.col("hi"))
    # the most that a set can share with the smallest of the others, or with one that holds nothing else
    smallest = F.greatest("least_n", F.col("n") - F.col("u"))
    able = ~F.col("two") | (100 * (F.col("n") - F.col("u")) >= percent * (smallest + F.col("u")))
    mixed = stash(placed.join(of, "key").where(able).select("key", "id", "n", "component"), "mixed", tidy=True)
    drop(large)
    ends = comps.select(F.col("node").alias("a"), F.col("component").alias("b"))
    if mixed.isEmpty():
        return ends
    whole = stash(_mapped(docs.join(mixed.select("id").distinct(), "id", "left_semi"), lambda s: (s,) if len(s) else None, "set array<long>", size), "whole", tidy=True)
    found = stash(_compared(_groups(mixed), whole, percent), "found", tidy=True)
    drop(mixed)
    drop(whole)
    return ends.unionAll(found)


def _groups(mixed: DataFrame) -> DataFrame:
    """(id, group, n, component): groups within which all pairs that share a signature meet.

    Sets that signatures tie, one after the other, are one group if that takes no more comparisons than all their signatures each
    do, as among near copies that share many; else each signature is a group.
    """
    first = mixed.groupBy("key").agg(F.min("id").alias("b"), F.count("*").alias("c"))
    tagged = stash(mixed.join(first, "key"), "tagged")
    tied = components(tagged.select(F.col("id").alias("a"), "b")).withColumnsRenamed({"node": "id", "component": "tied"})
    rows = stash(tagged.join(tied, "id"), "tied")  # a signature of one set alone compares nothing
    drop(tagged)
    once = rows.groupBy("tied", "id").agg(F.sum("c").alias("met"))
    worth = once.groupBy("tied").agg((F.count("*").cast("double") * F.count("*") <= F.sum("met").cast("double")).alias("whole"))
    each = rows.join(worth, "tied")
    together = each.where("whole").groupBy("id", "tied").agg(F.max("n").alias("n"), F.min("component").alias("component"))
    apart = each.where(~F.col("whole")).select("id", F.xxhash64("key", F.lit("key")).alias("group"), "n", "component")
    return together.select("id", F.xxhash64("tied", F.lit("tied")).alias("group"), "n", "component").unionAll(apart)


def _compared(members: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """(a, b): what links join in each group of (id, group, n, component), as edges between members of a component of each block; sets of one component aren't compared.

    A group is cut into blocks by its sets and shingles, and every two blocks meet in one task, which counts common shingles
    as a matrix product; no pair is a row but those that come out, fewer than a block has sets.
    """
    sizes = members.groupBy("group").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    rows = members.join(sizes, "group").select("id", "group", "component", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = rows.select("id", "group", "component", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    key = members.schema["id"].dataType.simpleString()

    def judge(_, table):
        import pyarrow as pa

        pairs = linked_within(table.column("set"), list(map(repr, table.column("component").to_pylist())), table.column("side").to_numpy(), percent)
        ids = table.column("id")
        return pa.table({"a": ids.take(pa.array(pairs[0], pa.int64())), "b": ids.take(pa.array(pairs[1], pa.int64()))})

    return rows.join(whole, "id").groupBy("group", "one", "two").applyInArrow(judge, f"a {key}, b {key}")


def linked_within(sets, component: list, side, percent: int):
    """(a, b), places of sets that links tie, enough for the components of all links between sets of unlike components; where there are two sides, of unlike sides."""
    import numpy as np

    offsets = np.concatenate([[0], np.cumsum([len(c) for c in sets.chunks], dtype=np.int64)]) if hasattr(sets, "chunks") else None
    parts = sets.chunks if offsets is not None else [sets]
    n = np.concatenate([np.diff(p.offsets.to_numpy()) for p in parts]) if parts else np.zeros(0, np.int64)
    flat = np.concatenate([p.flatten().to_numpy(zero_copy_only=False) for p in parts]) if parts else np.zeros(0, np.int64)
    m = len(n)
    code = np.unique(component, return_inverse=True)[1] if m else np.zeros(0, int)
    across = bool(m) and side.min() != side.max()
    left, right = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if across else (np.arange(m), np.arange(m))
    if not m or code.min() == code.max():
        return [], []
    row = np.repeat(np.arange(m), n)
    token, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    kept = times[column] > 1  # shingles of one set are common to none
    row, column = row[kept], (np.cumsum(times > 1) - 1)[column[kept]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, int((times > 1).sum()), COLUMNS):
        lo, hi = np.searchsorted(column, [at, at + COLUMNS])
        dense = np.zeros((m, COLUMNS), np.float32)
        dense[row[lo:hi], column[lo:hi] - at] = 1
        common += dense[left] @ dense[right].T
    common = common.astype(np.int64)
    link = (100 * common >= percent * (n[left][:, None] + n[right][None, :] - common)) & (code[left][:, None] != code[right][None, :])
    up = np.arange(m)

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for x, y in zip(*np.nonzero(link), strict=True):
        a, b = top(left[x]), top(right[y])
        if a != b:
            up[max(a, b)] = min(a, b)
            out.append((int(left[x]), int(right[y])))
    return [a for a, _ in out], [b for _, b in out]
