"""Dependency graphs as edge tables: degrees, neighbours, paths, components."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from quern.operators.ordinals import numbered
from quern.sources.shared import forget, written


def edges_of(df: DataFrame, name: str, tokens: str) -> DataFrame:
    """(src, token), distinct: rows that share a name merge."""
    return df.where(F.col(name).isNotNull()).select(F.col(name).alias("src"), F.explode(tokens).alias("token")).distinct()


def internal(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose token is a node."""
    return edges.join(nodes.select(F.col("node").alias("token")), "token", "left_semi")


def unresolved(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return edges.join(nodes.select(F.col("node").alias("token")), "token", "left_anti")


def marked(edges: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """(src, token, internal), distinct: whether an edge's token is a node, by one join in n partitions; nodes are distinct. Edges are shuffled once, by token."""
    dealt = edges.select("src", "token").repartition(n, "token").distinct()
    known = nodes.select(F.col("node").alias("__node")).repartition(n, "__node").withColumn("__known", F.lit(True))
    return dealt.join(known.hint("merge"), F.col("token") == F.col("__node"), "left").select("src", "token", F.coalesce("__known", F.lit(False)).alias("internal"))


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, out_degree, in_degree): out counts all tokens, in the internal edges; nodes without either have 0."""
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("out_degree"))
    into = internal(edges, nodes).groupBy(F.col("token").alias("node")).agg(F.count("*").alias("in_degree"))
    joined = nodes.join(out, "node", "left").join(into, "node", "left")
    return joined.select("node", F.coalesce("out_degree", F.lit(0)).alias("out_degree"), F.coalesce("in_degree", F.lit(0)).alias("in_degree"))


def shape(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: nodes, edges, roots (nothing leads in), leaves (nothing leads out)."""
    d = degrees(edges, nodes)
    return d.agg(F.count("*").alias("nodes"), F.sum("out_degree").alias("edges"), F.count_if(F.col("in_degree") == 0).alias("roots"), F.count_if(F.col("out_degree") == 0).alias("leaves"))


def chains(edges: DataFrame) -> DataFrame | None:
    """(node, end, w, least, ring), written, for the nodes of edges (s, d, w) that one edge leads to and one leads from; None without any.

    end: the first node further on that isn't such a node, w: the weight of the way there, least: the smallest chain node on the way, the node
    itself included. ring: the way never leaves the chain, which is a cycle of its own; least is then that of the cycle. Each
    round doubles how far a node sees, so there are as many rounds as the longest chain's length has binary digits.
    """
    out = edges.groupBy(F.col("s").alias("node")).agg(F.count("*").alias("o"), F.min("d").alias("end"), F.min("w").alias("w"))
    into = edges.groupBy(F.col("d").alias("node")).agg(F.count("*").alias("i"))
    alone = out.join(into.hint("merge"), "node").where((F.col("o") == 1) & (F.col("i") == 1))
    t = written(alone.select("node", "end", "w", F.col("node").alias("least")), "chains")
    left = n = t.count()
    for _ in range(math.ceil(math.log2(max(n, 1))) + 1):
        if not left:
            break
        on = t.select(F.col("node").alias("end"), F.col("end").alias("__end"), F.col("w").alias("__w"), F.col("least").alias("__least"))
        seen = Observation()
        far = t.join(on.hint("merge"), "end", "left").select("node", F.coalesce("__end", "end").alias("end"), (F.col("w") + F.coalesce("__w", F.lit(0))).alias("w"), F.least("least", F.coalesce("__least", "least")).alias("least"), F.col("__end").isNotNull().alias("open"))
        new = written(far.observe(seen, F.count_if("open").alias("open")).drop("open"), "chains")
        forget(t)
        t, left = new, seen.get["open"]
    if not n:
        forget(t)
        return None
    ring = t.join(t.select(F.col("node").alias("end"), F.lit(True).alias("ring")).hint("merge"), "end", "left") if left else t.withColumn("ring", F.lit(False))
    out = written(ring.select("node", "end", "w", "least", F.coalesce("ring", F.lit(False)).alias("ring")), "chains")
    forget(t)
    return out


def longest_path(edges: DataFrame, src: str = "src", dst: str = "dst") -> int | None:
    """Edges on the longest path; None if there is a cycle.

    Edges carry the length of the way that they stand for, nodes the longest way to them so far. In turn, chains of nodes with one way in and
    one way out become one edge each, and nodes that nothing leads to any more hand on their length and go. So jobs grow with how
    branchings follow one another, and with the logarithm of the chains between. Edges that are left when no node can go lie on a cycle.
    """
    e = written(edges.select(F.col(src).alias("s"), F.col(dst).alias("d"), F.lit(1).cast("long").alias("w")).where(F.col("s").isNotNull() & F.col("d").isNotNull()).distinct(), "edges")
    far = None
    best, n = 0, e.count()
    while n:
        line = chains(e)
        if line is not None:
            if not line.where("ring").isEmpty():
                forget(*[x for x in (e, far, line) if x is not None])
                return None
            of_chain = line.select(F.col("node").alias("__node"), "end", F.col("w").alias("__w"))
            outer = e.join(line.select(F.col("node").alias("s")), "s", "left_anti").join(of_chain, F.col("d") == F.col("__node"), "left")
            outer = outer.select("s", F.coalesce("end", "d").alias("d"), (F.col("w") + F.coalesce("__w", F.lit(0))).alias("w"))
            if far is not None:
                moved = far.join(of_chain, F.col("node") == F.col("__node"), "left").select(F.coalesce("end", "node").alias("node"), (F.col("far") + F.coalesce("__w", F.lit(0))).alias("far"))
                new = written(moved.groupBy("node").agg(F.max("far").alias("far")), "far")
                forget(far)
                far = new
            new = written(outer.groupBy("s", "d").agg(F.max("w").alias("w")), "edges")
            forget(e, line)
            e = new
        if not e.where(F.col("s") == F.col("d")).isEmpty():
            forget(*[x for x in (e, far) if x is not None])
            return None
        first = e.select(F.col("s").alias("node")).distinct().join(e.select(F.col("d").alias("node")).distinct(), "node", "left_anti")
        going = e.join(first, F.col("s") == F.col("node"), "left_semi")
        to = (going if far is None else going.join(far.withColumnRenamed("node", "s"), "s", "left")).select(F.col("d").alias("node"), (F.col("w") + (F.lit(0) if far is None else F.coalesce("far", F.lit(0)))).alias("far"))
        if far is not None:
            to = to.unionAll(far)
        seen, rest = Observation(), Observation()
        new = written(to.groupBy("node").agg(F.max("far").alias("far")).observe(seen, F.max("far").alias("best")), "far")
        left = written(e.join(first, F.col("s") == F.col("node"), "left_anti").observe(rest, F.count(F.lit(1)).alias("n")), "edges")
        forget(*[x for x in (e, far) if x is not None])
        e, far, best = left, new, max(best, seen.get["best"] or 0)
        if rest.get["n"] == n:
            forget(e, far)
            return None
        n = rest.get["n"]
    forget(*[x for x in (e, far) if x is not None])
    return best


def khop(edges: DataFrame, seeds: DataFrame, hops: int, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, hop): nodes within so many steps of the seeds, and the fewest steps."""
    e = edges.select(F.col(src).alias("s"), F.col(dst).alias("d")).distinct()
    found = seeds.select("node", F.lit(0).alias("hop")).distinct()
    front = found
    for k in range(1, hops + 1):
        step = front.join(e, front["node"] == e["s"]).select(F.col("d").alias("node")).distinct()
        front = step.join(found, "node", "left_anti").select("node", F.lit(k).alias("hop"))
        found = found.unionAll(front)
    return found


def connected_components(edges: DataFrame, nodes: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component), the smallest node that links reach.

    Links are turned into stars: each round every node's larger neighbours are tied to its smallest one, then its smaller ones, until
    nothing changes. No component is held in one place, and rounds grow with the logarithm of the longest path.
    """
    x, y = F.col(src), F.col(dst)
    star = written(edges.where(x.isNotNull() & y.isNotNull() & (x != y)).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct(), "stars")
    before = None
    while True:
        both = star.unionAll(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        rest = large.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        seen = Observation()
        mark = F.xxhash64("u", "v").cast("decimal(38,0)")
        new = written(low.select("u", F.col("m").alias("v")).unionAll(rest).distinct().observe(seen, F.count(F.lit(1)).alias("n"), F.sum(mark).alias("mark")), "stars")
        forget(star)
        star, now = new, (seen.get["n"], seen.get["mark"])
        if now == before:
            break
        before = now
    return nodes.select("node").distinct().join(star.select(F.col("u").alias("node"), "v"), "node", "left").select("node", F.coalesce("v", "node").alias("component"))


def dependency_edges(df: DataFrame, name: str, kinds: dict[str, str]) -> DataFrame:
    """(src, token, dep_kind), distinct: tokens of the array columns named by kind, and union for each token of any kind."""
    parts = [edges_of(df, name, c).withColumn("dep_kind", F.lit(k)) for k, c in kinds.items()]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionAll(p)
    return every.unionAll(every.select("src", "token").distinct().withColumn("dep_kind", F.lit("union")))


def definition_report(df: DataFrame, name: str, tokens: str, n: int = 20) -> DataFrame:
    """One row: rows, nodes, collapsed_rows, internal_edges, unresolved_occurrences, unresolved_qualified, distinct_unresolved, self_loops, and as array<struct<key, count>> the n names most depended upon and the n unresolved tokens met most.

    Rows that share a name merge; rows without a name count as collapsed.
    """
    from quern.functions.text import looks_qualified
    from quern.operators.stats import counts_by, top_n

    named = df.where(F.coalesce(F.col(name), F.lit("")) != "")
    nodes = named.select(F.col(name).alias("node")).distinct()
    e = edges_of(named, name, tokens)
    known = nodes.select(F.col("node").alias("__n"))
    met = e.join(known, F.col("token") == F.col("__n"), "left")
    of = met.agg(
        F.count("__n").alias("internal_edges"), F.count_if(F.col("__n").isNull()).alias("unresolved_occurrences"),
        F.count_if(F.col("__n").isNull() & looks_qualified(F.col("token"))).alias("unresolved_qualified"),
        F.countDistinct(F.when(F.col("__n").isNull(), F.col("token"))).alias("distinct_unresolved"), F.count_if(F.col("__n") == F.col("src")).alias("self_loops"),
    )
    best = lambda d, c: top_n(counts_by(d, "token"), n).agg(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("c"), "key"))).alias("l")).select(F.transform("l", lambda x: F.struct(x["key"].alias("key"), (-x["c"]).alias("count"))).alias(c))
    sizes = df.agg(F.count("*").alias("rows")).crossJoin(nodes.agg(F.count("*").alias("nodes")))  # one row each, as the others
    out = sizes.crossJoin(of).crossJoin(best(internal(e, nodes), "most_depended_upon")).crossJoin(best(unresolved(e, nodes), "most_unresolved"))
    return out.select("rows", "nodes", (F.col("rows") - F.col("nodes")).alias("collapsed_rows"), "internal_edges", "unresolved_occurrences", "unresolved_qualified", "distinct_unresolved", "self_loops", "most_depended_upon", "most_unresolved")


def reverse_index(edges: DataFrame) -> DataFrame:
    """(token, n, sources): the definitions that mention each token, in order; the lists are what is asked for."""
    return edges.groupBy("token").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("src")).alias("sources"))


def reverse_blocks(edges: DataFrame, size: int = 1024) -> DataFrame:
    """(token, block, n, sources): the same in rows of at most size definitions, cut where the number of an edge among all, by token and definition,
    passes a multiple of size. For tokens that a large share of all definitions mention. The result reads a written table: forget it when it is done with."""
    rows = numbered(edges.select("token", "src").distinct(), "token", "src")
    out = rows.groupBy("token", F.floor(F.col("row") / size).alias("block")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list("src")).alias("sources"))
    out.written_at = rows.written_at
    return out


def strong_components(edges: DataFrame, nodes: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): the smallest node of each strongly connected component.

    First each chain of nodes with one way in and one way out becomes one edge: its nodes are in a component if, and only if, both its ends are
    in that one; a chain that closes upon itself is a component. Of the rest each round drops nodes that nothing leads to
    or that lead nowhere, again and again: each is a component of its own. What is left is coloured forward by the
    smallest node that reaches a node; the nodes of a colour that lead back to it are its component. Every round settles some nodes, so it ends;
    no component is held in one place. Tables are joined by shuffles at any size: small ones that are broadcast in each round add up at the driver.
    """
    every = nodes.select("node").distinct()
    ends = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull())
    known = every.union(ends.select(F.col(src))).union(ends.select(F.col(dst))).distinct()  # ways may lead over nodes that aren't asked for
    whole = written(edges.select(F.col(src).alias("s"), F.col(dst).alias("d"), F.lit(1).alias("w")).where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst))).distinct(), "edges")
    line = chains(whole)
    if line is None:
        return every.join(_strong(whole.select("s", "d"), known).hint("merge"), "node")
    back = chains(whole.select(F.col("d").alias("s"), F.col("s").alias("d"), "w")).select("node", F.col("end").alias("start"))
    outer = whole.join(line.select(F.col("node").alias("s")).hint("merge"), "s", "left_anti").join(line.select(F.col("node").alias("d"), "end").hint("merge"), "d", "left")
    short = written(outer.select("s", F.coalesce("end", "d").alias("d")).where(F.col("s") != F.col("d")).distinct(), "edges")
    forget(whole)
    rest = written(_strong(short, known.join(line.select("node").hint("merge"), "node", "left_anti")), "components")
    at = lambda c: rest.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}")).hint("merge")
    placed = line.where(~F.col("ring")).join(back.hint("merge"), "node").join(at("start"), "start", "left").join(at("end"), "end", "left")
    inner = placed.select("node", F.when(F.col("of_start") == F.col("of_end"), F.col("of_start")).alias("of"))
    rings = line.where("ring").select("node", F.col("least").alias("component"))
    alone = inner.where(F.col("of").isNull()).select("node", F.col("node").alias("component"))
    # a component is named anew where one of its chains holds a smaller node
    tied = rest.select("node", F.col("component").alias("of")).unionAll(inner.where(F.col("of").isNotNull()))
    least = tied.groupBy("of").agg(F.min("node").alias("component"))
    found = tied.join(least.hint("merge"), "of").select("node", "component").unionAll(alone).unionAll(rings)
    return every.join(found.hint("merge"), "node")


def _strong(e: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, component) by colours, of edges (s, d) without loops."""
    left, e = written(nodes, "nodes"), written(e, "edges")
    done = None
    add = lambda found: found if done is None else done.unionAll(found)
    inside = lambda: e.join(left.select(F.col("node").alias("s")).hint("merge"), "s", "left_semi").join(left.select(F.col("node").alias("d")).hint("merge"), "d", "left_semi").select("s", "d")

    def swap(old: DataFrame, new: DataFrame, name: str) -> DataFrame:
        new = written(new, name)
        forget(old)
        return new

    while True:
        while True:  # nodes without a way in or out
            both = e.select(F.col("s").alias("node")).distinct().join(e.select(F.col("d").alias("node")).hint("merge"), "node", "left_semi")
            alone = written(left.join(both.hint("merge"), "node", "left_anti"), "alone")
            if alone.isEmpty():
                break
            done = add(alone.select("node", F.col("node").alias("component")))
            left = swap(left, left.join(alone.hint("merge"), "node", "left_anti"), "nodes")
            e = swap(e, inside(), "edges")
        if left.isEmpty():
            forget(left, e)
            return done if done is not None else nodes.select("node", F.col("node").alias("component"))
        colour = _spread(e, left.select("node", F.col("node").alias("label")), "s", "d")
        own = colour.select(F.col("node").alias("s"), F.col("label").alias("ls"))
        inner = written(e.join(own.hint("merge"), "s").join(colour.select(F.col("node").alias("d"), F.col("label").alias("ld")).hint("merge"), "d").where(F.col("ls") == F.col("ld")).select("s", "d"), "inner")
        back = _reached(inner, colour.where(F.col("node") == F.col("label")).select("node", "label"))
        forget(inner, colour)
        done = add(back.select("node", F.col("label").alias("component")))
        left = swap(left, left.join(back.hint("merge"), "node", "left_anti"), "nodes")
        e = swap(e, inside(), "edges")


def _spread(e: DataFrame, labels: DataFrame, a: str, b: str) -> DataFrame:
    """(node, label), written: the smallest label that reaches a node along edges from a to b. Each round a label goes one edge on, and then to where its own node's label has come."""
    labels = written(labels, "labels")
    while True:
        near = e.join(labels.hint("merge"), e[a] == labels["node"]).groupBy(F.col(b).alias("__b")).agg(F.min("label").alias("__least"))
        seen = Observation()
        step = labels.join(near.hint("merge"), labels["node"] == near["__b"], "left").select("node", F.least("label", F.coalesce("__least", "label")).alias("label"), F.col("label").alias("old"))
        jump = labels.select(F.col("node").alias("__j"), F.col("label").alias("__further"))
        step = step.join(jump.hint("merge"), step["label"] == jump["__j"], "left").select("node", F.least("label", F.coalesce("__further", "label")).alias("label"), "old")
        new = written(step.observe(seen, F.count_if(F.col("label") != F.col("old")).alias("moved")).select("node", "label"), "labels")
        forget(labels)
        labels = new
        if not seen.get["moved"]:
            return labels


def _reached(e: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, label), written, of nodes that lead to a root, by the root's label."""
    found, front = written(roots, "found"), written(roots, "front")
    while True:
        step = front.join(e.hint("merge"), front["node"] == e["d"]).select(F.col("s").alias("node"), "label").distinct()
        new = written(step.join(found.select("node").hint("merge"), "node", "left_anti"), "front")
        forget(front)
        front = new
        if front.isEmpty():
            forget(front)
            return found
        new = written(found.unionAll(front), "found")
        forget(found)
        found = new
