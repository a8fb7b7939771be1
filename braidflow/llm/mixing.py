"""Mixing sources to target weights by hierarchical budgeting.

Documents are the leaves' tokens of a tree, here domain, language and source. A total
budget goes down the tree by weights; what a node can't use (it has at most MAX_EPOCHS
times its tokens) goes to its siblings by their weights, and only what a whole family can't
use reaches the next family up. A leaf of budget b and t tokens takes floor(b / t) whole
epochs and of the next one the longest prefix of its documents, in an order seeded by the
epoch, that fits.

The families above the leaves (at most MAX_FAMILIES, checked) are the only thing on the
driver; leaves, of any number, get theirs by windows over their family. The cut of a prefix
is found by narrowing a range of the seeded hash: sums over 512 cells of a leaf, then over
512 cells of the one in which the budget ends, and at last the documents of one cell of
2^18; no leaf is ever sorted as a whole. All of it is DataFrame operations.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

LEVELS = ("domain", "lang", "source")
MAX_EPOCHS = 2
MAX_FAMILIES = 200_000
#: A plan of as many leaves is broadcast; a longer one meets the documents in a shuffle.
BROADCAST_LEAVES = 200_000
#: Ranges of hashes are cut into 2^CELL_BITS so many times on the way to a leaf's cut.
CELL_BITS, CELL_STEPS = 9, 2
SEED = 7
#: The budget as a part of all tokens.
SHARE = 1.0

#: What a name weighs that its level doesn't list; at a level that lists none, all weigh 1.
UNLISTED = 0.1
# Target weights by name at each level.
WEIGHTS: dict[str, dict[str, float]] = {"domain": {"web": 0.5, "books": 0.3, "code": 0.2}, "lang": {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}}


def domain_of(source: Column) -> Column:
    """Documents name no domain: sources are dealt to three by their name's crc32."""
    return F.element_at(F.array(*(F.lit(x) for x in ("web", "books", "code"))), (F.crc32(source.cast("binary")) % 3 + 1).cast("int"))


def n_tokens(text: Column) -> Column:
    """Words between white space, at least one, so that every document counts."""
    return F.greatest(F.lit(1), F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+"))).cast("long")


@dataclass
class Leaf:
    path: tuple[str, ...]
    tokens: int
    budget: float = 0.0


def fill(budget: float, parts: list[tuple[float, float]]) -> list[float]:
    """Deal a budget to (weight, capacity) parts; shortages go to the others by weight."""
    given = [0.0] * len(parts)
    open_, left = [i for i, (w, c) in enumerate(parts) if w > 0 and c > 0], budget
    while open_ and left > 1e-9:
        whole = sum(parts[i][0] for i in open_)
        short = [i for i in open_ if parts[i][1] <= left * parts[i][0] / whole]
        if not short:
            for i in open_:
                given[i] = left * parts[i][0] / whole
            return given
        for i in short:
            given[i] = parts[i][1]
        left -= sum(parts[i][1] for i in short)
        open_ = [i for i in open_ if i not in set(short)]
    return given


def weight_of(level: str, name: str, weights: dict[str, dict[str, float]]) -> float:
    return weights[level].get(name, UNLISTED) if level in weights else 1.0


def budgets(leaves: list[Leaf], total: float, weights: dict[str, dict[str, float]], levels: tuple[str, ...], epochs: float) -> None:
    """Set the leaves' budgets, top down; a node's capacity is all that its leaves can use,
    that is those without a weight of 0 on their way."""

    def usable(own: list[Leaf], depth: int) -> float:
        return epochs * sum(x.tokens for x in own if all(weight_of(level, n, weights) > 0 for level, n in zip(levels[depth:], x.path[depth:])))

    def deal(own: list[Leaf], depth: int, budget: float) -> None:
        if depth == len(levels):
            own[0].budget = budget
            return
        families: dict[str, list[Leaf]] = {}
        for leaf in own:
            families.setdefault(leaf.path[depth], []).append(leaf)
        names = sorted(families)
        parts = [(weight_of(levels[depth], n, weights), usable(families[n], depth + 1)) for n in names]
        for name, share in zip(names, fill(budget, parts)):
            deal(families[name], depth + 1, share)

    if leaves:
        deal(leaves, 0, min(total, usable(leaves, 0)))


def _leaf_budgets(leaves: DataFrame, budgeted: DataFrame, keys: list[str], weights: dict[str, float] | None, epochs: int) -> DataFrame:
    """The leaves with their budgets out of their families': ``fill`` as windows.

    With leaves in order of capacity by weight (their level), those are full up to which the
    budget covers the full ones and what all others get at the same level; the rest share
    what is left by weight. Leaves of one level are summed first, so a window sees a
    family's distinct levels, however many leaves it has; what it finds, a row per family
    (MAX_FAMILIES at most), goes back to them.
    """
    if weights is None:
        weight = F.lit(1.0)
    else:
        listed = F.create_map(*[F.lit(x) for pair in sorted(weights.items()) for x in pair]) if weights else None
        weight = F.coalesce(listed[F.col(keys[-1])], F.lit(UNLISTED)) if listed is not None else F.lit(UNLISTED)
    up = keys[:-1]
    rows = leaves.join(F.broadcast(budgeted), up).withColumn("w", weight).withColumn("cap", F.lit(float(epochs)) * F.col("tokens"))
    open_ = rows.where("w > 0").withColumn("level", F.col("cap") / F.col("w"))
    levels = open_.groupBy(*up, "family_budget", "level").agg(F.sum("cap").alias("cap"), F.sum("w").alias("w"))
    family = Window.partitionBy(*up)
    up_to = family.orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    levels = levels.select("*", F.sum("cap").over(up_to).alias("caps"), F.sum("w").over(up_to).alias("ws"), F.sum("w").over(family).alias("all_w"))
    full = F.col("family_budget") >= F.col("caps") + F.col("level") * (F.col("all_w") - F.col("ws")) - 1e-9
    edges = levels.groupBy(*up).agg(F.max(F.when(full, F.col("level"))).alias("edge"), F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0.0)).alias("full_cap"), F.coalesce(F.sum(F.when(full, F.col("w"))), F.lit(0.0)).alias("full_w"), F.max("all_w").alias("all_w"))
    met = open_.join(F.broadcast(edges), up)
    share = (F.col("family_budget") - F.col("full_cap")) / (F.col("all_w") - F.col("full_w")) * F.col("w")
    dealt = met.withColumn("budget", F.when(F.col("level") <= F.col("edge"), F.col("cap")).otherwise(F.greatest(share, F.lit(0.0)))).select(*keys, "tokens", "budget")
    return dealt.unionByName(rows.where("w <= 0").select(*keys, "tokens", F.lit(0.0).alias("budget")))


def _prepared(docs: DataFrame, leaf: list[Column]) -> DataFrame:
    """The documents' columns in a struct (so that no name clashes), their leaf and tokens."""
    return docs.select(F.struct(*docs.columns).alias("doc"), *(c.alias(f"k{i}") for i, c in enumerate(leaf)), F.col("doc_id").cast("long").alias("id"), n_tokens(F.col("text").cast("string")).alias("n_tokens"))


def leaf_columns() -> list[Column]:
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    return [domain_of(source), F.coalesce(F.col("lang").cast("string"), F.lit("")), source]


def _order(epoch: Column) -> Column:
    return F.xxhash64(F.lit(SEED), epoch, F.col("id"))


def plan(rows: DataFrame, share: float = SHARE, weights: dict[str, dict[str, float]] | None = None, levels: tuple[str, ...] = LEVELS, epochs: int = MAX_EPOCHS) -> DataFrame:
    """Per leaf: k0.., tokens, budget, whole (epochs) and cut (the greatest seeded hash that
    the next epoch's prefix has; null for none).

    rows: k0.., id, n_tokens. The prefix never exceeds the budget; documents of one hash
    (repeated rows) stay together.
    """
    spark = rows.sparkSession
    keys = [f"k{i}" for i in range(len(levels))]
    weights = WEIGHTS if weights is None else weights
    leaves = common.written(rows.groupBy(*keys).agg(F.sum("n_tokens").alias("tokens")), "mix-leaves")
    ignored = [n for n, w in weights.get(levels[-1], {}).items() if w <= 0]
    usable = ~F.col(keys[-1]).isin(ignored) if ignored else F.lit(True)
    found = leaves.groupBy(*keys[:-1]).agg(F.sum("tokens").alias("tokens"), F.coalesce(F.sum(F.when(usable, F.col("tokens"))), F.lit(0)).alias("usable")).limit(MAX_FAMILIES + 1).collect()
    if len(found) > MAX_FAMILIES:
        raise ValueError(f"over {MAX_FAMILIES} families of leaves; merge the rarest first")
    families = [Leaf(tuple(r[k] for k in keys[:-1]), r["usable"]) for r in found]
    budgets(families, share * sum(r["tokens"] for r in found), weights, levels[:-1], epochs)
    schema = ", ".join([*(f"{k} string" for k in keys[:-1]), "family_budget double"])
    dealt = _leaf_budgets(leaves, spark.createDataFrame([(*x.path, float(x.budget)) for x in families], schema), keys, weights.get(levels[-1]), epochs)
    whole = F.floor((F.col("budget") + 1e-6) / F.col("tokens")).cast("int")
    tree = dealt.withColumn("whole", whole).withColumn("rest", F.floor(F.col("budget") + 1e-6 - F.col("whole") * F.col("tokens")).cast("long"))
    tree = common.written(tree, "mix-tree")
    beside = F.broadcast if _few(tree) else lambda by_leaf: by_leaf  # of a row per leaf at most
    hashed = rows.join(beside(tree.where("rest > 0")), keys).select(*keys, "rest", "n_tokens", _order(F.col("whole")).alias("h"))
    by_leaf, edge = Window.partitionBy(*keys), None
    for bits in range(CELL_BITS, CELL_BITS * CELL_STEPS + 1, CELL_BITS):
        cell = F.shiftright("h", 64 - bits).alias("cell")
        inside = hashed.withColumn("before", F.lit(0).cast("long")) if edge is None else _inside(hashed, beside(edge), keys, bits - CELL_BITS)
        cells = inside.groupBy(*keys, "rest", "before", cell).agg(F.sum("n_tokens").alias("n"))
        cells = cells.withColumn("up_to", F.col("before") + F.sum("n").over(by_leaf.orderBy("cell")))
        edge = cells.where("up_to > rest AND up_to - n <= rest").select(*keys, F.col("cell").alias("edge"), (F.col("up_to") - F.col("n")).alias("before"))
        edge = common.written(edge, "mix-edges")  # a row per leaf at most
    inside = _inside(hashed, beside(edge), keys, bits).groupBy(*keys, "rest", "before", "h").agg(F.sum("n_tokens").alias("n"))
    reach = F.col("before") + F.sum("n").over(by_leaf.orderBy("h"))
    last = inside.withColumn("reach", reach).where("reach <= rest").groupBy(*keys).agg(F.max("h").alias("last"))
    floor = F.shiftleft(F.col("edge"), 64 - bits)  # the edge's own least hash
    cuts = edge.join(last, keys, "left").select(*keys, F.coalesce("last", F.when(F.col("edge") > -(1 << bits - 1), floor - 1)).alias("cut"))
    return common.written(tree.join(cuts, keys, "left").drop("rest"), "mix-plan")


def _inside(hashed: DataFrame, edge: DataFrame, keys: list[str], bits: int) -> DataFrame:
    """The rows of each leaf in its edge's range of hashes."""
    return hashed.join(edge, keys).where(F.shiftright("h", 64 - bits) == F.col("edge")).drop("edge")


def _few(by_leaf: DataFrame) -> bool:
    """Whether a table of leaves has BROADCAST_LEAVES rows at most: it is broadcast then to
    meet documents, so that the corpus isn't dealt out by leaf, of which one may hold a third
    of it. Beyond, adaptive execution splits such a leaf."""
    return by_leaf.limit(BROADCAST_LEAVES + 1).count() <= BROADCAST_LEAVES


def select(rows: DataFrame, planned: DataFrame, levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """rows with copies: how often the mixture has the document (0: not at all).

    rows: k0.., id, n_tokens and any other columns; those named as the plan's (tokens, budget,
    whole, cut) would clash, so callers keep theirs in a struct. Rows of one id in one leaf
    have equal copies; a null id is one id. Rows whose leaf the plan lacks, or has null as a
    name, go; ``mix`` makes none. An empty table gives no rows.
    """
    keys = [f"k{i}" for i in range(len(levels))]
    extra = (F.col("cut").isNotNull() & (_order(F.col("whole")) <= F.col("cut"))).cast("int")
    return rows.join(F.broadcast(planned) if _few(planned) else planned, keys).withColumn("copies", F.col("whole") + extra)


def mix(docs: DataFrame, share: float = SHARE) -> DataFrame:
    """doc, k0 (domain), k1 (language), k2 (source), id, n_tokens, copies of every document.

    Null language or source: ''. Null text: one token. Null doc_ids share one place in the
    order, as rows of equal doc_id do. An empty table gives no rows.
    """
    rows = _prepared(docs, leaf_columns())
    small = common.written(rows.select("k0", "k1", "k2", "id", "n_tokens"), "mix-rows")
    return select(rows, plan(small, share))


def mix_digest(docs: DataFrame) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens, copies of every document; odd input as in ``mix``.

    Repeated rows have equal copies; columns of any other name are ignored; a text of any
    length is one document.
    """
    rows = common.written(_prepared(docs, leaf_columns()).drop("doc"), "mix-rows")
    return select(rows, plan(rows)).select(F.col("id").alias("doc_id"), F.col("k0").alias("domain"), F.col("k1").alias("lang"), F.col("k2").alias("source"), "n_tokens", "copies")


def mixed(docs: DataFrame) -> DataFrame:
    """The mixture: the documents with all their columns, each as often as it was taken."""
    chosen = mix(docs).where("copies > 0").withColumn("__copy", F.explode(F.expr("sequence(1, copies)")))
    return chosen.select("doc.*")
