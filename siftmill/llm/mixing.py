"""Mixing sources to target weights by hierarchical budgeting.

The documents form a tree: domain - language - source. Target weights hold among the
children of each node. A budget of tokens flows down: a node divides what it has among
its children by weight, capped by what a child can give (its tokens times
``max_epochs``). What a child cannot use goes to its siblings, and since every node is
itself capped by the sum below it, only what a whole family lacks reaches its parent's
siblings. Each leaf then takes whole seeded epochs and, of one further epoch, the prefix
of its seeded order whose running total stays within the rest of its budget.

Arithmetic is in integers throughout, so results do not depend on the order of rows.

Defined results: a null domain, language or source is the child named ''. Documents
without tokens (null, empty or blank text) are never selected. Rows with the same doc_id
share their place in the order and are taken or left together. A null doc_id is a value
like any other. A weight that is not given is ``other``; a family whose weights are all 0
gets nothing. An empty table gives an empty result. Budgets are rounded down, so less
than one token for each child stays unspent. Other columns are ignored (or, in
``mixed``, kept; columns named mix_epoch or mix_key give way to those that it adds). Names
and weights may hold any signs.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, documents

TOKEN = r"[^ \t\r\n]+"
#: Leaves that may be broadcast; more are joined by shuffling.
BROADCAST_LEAVES = 100_000


@dataclass(frozen=True)
class Mix:
    """Production parameters. ``domains``: (regular expression of the source, domain), the first that fits."""

    domains: tuple[tuple[str, str], ...] = (("^src0$", "crawl"), ("^src[1-5]$", "reference"), ("^src[6-9]$", "news"))
    domain_weights: dict[str, int] = field(default_factory=lambda: {"crawl": 20, "reference": 40, "news": 25})
    lang_weights: dict[str, int] = field(default_factory=lambda: {"en": 50, "fr": 20, "de": 20, "es": 10})
    source_weights: dict[str, int] = field(default_factory=lambda: {"src1": 30, "src2": 20})
    other: int = 10
    #: Budget as a share of all tokens, in hundredths.
    percent: int = 90
    max_epochs: int = 3
    seed: int = 17

    def weight(self, column: str, weights: dict[str, int]) -> Column:
        out = F.lit(self.other)
        for k, v in weights.items():
            out = F.when(F.col(column) == F.lit(k), v).otherwise(out)
        return out.cast("long")

    def domain(self) -> Column:
        """The domain of ``source``."""
        out = F.when(F.col("source") == "", "").otherwise("other")
        for pattern, name in reversed(self.domains):
            out = F.when(F.col("source").rlike(pattern), F.lit(name)).otherwise(out)
        return out

    def weight_sql(self, column: str, weights: dict[str, int]) -> str:
        return f"CASE {column} " + " ".join(f"WHEN {_quoted(k)} THEN {v}" for k, v in weights.items()) + f" ELSE {self.other} END" if weights else str(self.other)

    def domain_sql(self) -> str:
        return "CASE " + " ".join(f"WHEN regexp_matches(source, {_quoted(p)}) THEN {_quoted(d)}" for p, d in self.domains) + " WHEN source = '' THEN '' ELSE 'other' END"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


LEAF = ["domain", "lang", "source"]


def _located(docs: DataFrame, mix: Mix) -> DataFrame:
    named = docs.select(F.col("doc_id").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), "text")
    return named.select("doc_id", mix.domain().alias("domain"), "lang", "source", F.coalesce(F.regexp_count("text", F.lit(TOKEN)), F.lit(0)).cast("long").alias("n_tokens"))


def _key(mix: Mix, epoch: Column, doc_id: Column) -> Column:
    return F.substring(F.md5(F.concat_ws(":", F.lit(str(mix.seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("null")))), 1, 16)


def _divide(children: DataFrame, parent: list[str], name: str, weight: Column) -> DataFrame:
    """Adds ``budget`` to children(parent..., name, cap, parent_budget): water-filling by integers."""
    family = Window.partitionBy(*[F.col(p) for p in parent]) if parent else Window.partitionBy(F.lit(0))
    order = family.orderBy(F.expr("cap / CAST(w AS DOUBLE)"), name)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    zero = F.lit(0).cast("long")
    out = children.withColumn("w", weight).where("w > 0")
    out = out.withColumn("rest", F.col("parent_budget") - F.coalesce(F.sum("cap").over(before), zero)).withColumn("rest_w", F.sum("w").over(family) - F.coalesce(F.sum("w").over(before), zero))
    out = out.withColumn("full", F.min(F.expr("CASE WHEN cap * rest_w <= w * rest THEN 1 ELSE 0 END")).over(upto))
    open_w, taken = F.sum(F.expr("CASE WHEN full = 0 THEN w ELSE 0 END")).over(family), F.sum(F.expr("CASE WHEN full = 1 THEN cap ELSE 0 END")).over(family)
    out = out.withColumn("open_w", open_w).withColumn("taken", taken)
    return out.withColumn("budget", F.expr("CASE WHEN full = 1 THEN cap ELSE (parent_budget - taken) * w div open_w END")).drop("w", "rest", "rest_w", "full", "open_w", "taken", "parent_budget")


def budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """(domain, lang, source, tokens, budget) from the leaves' (domain, lang, source, tokens)."""
    leaves = leaves.withColumn("cap", F.col("tokens") * mix.max_epochs)
    langs = leaves.groupBy("domain", "lang").agg(F.sum("cap").alias("cap"))
    tops = leaves.groupBy("domain").agg(F.sum("cap").alias("cap"))
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0] * mix.percent // 100
    tops = _divide(tops.withColumn("parent_budget", F.lit(total).cast("long")), [], "domain", mix.weight("domain", mix.domain_weights))
    langs = langs.join(tops.select("domain", F.col("budget").alias("parent_budget")), "domain")
    langs = _divide(langs, ["domain"], "lang", mix.weight("lang", mix.lang_weights))
    below = leaves.join(langs.select("domain", "lang", F.col("budget").alias("parent_budget")), ["domain", "lang"])
    return _divide(below, ["domain", "lang"], "source", mix.weight("source", mix.source_weights)).drop("cap")


def plan(docs: DataFrame, mix: Mix) -> tuple[DataFrame, DataFrame]:
    """What each leaf takes: (slim documents, leaves with whole epochs and the cut of the last one).

    The cut is found in two steps, so that no task ever sorts a whole leaf: token sums of
    4096 ranges of the seeded order, then the order within the one range that the budget ends in.
    """
    slim = cut(_located(docs, mix).where("n_tokens > 0"))
    leaves = budgets(cut(slim.groupBy(*LEAF).agg(F.sum("n_tokens").alias("tokens"))), mix)
    leaves = leaves.withColumn("whole", F.least(F.expr("budget div tokens"), F.lit(mix.max_epochs).cast("long")))
    leaves = cut(leaves.withColumn("rest", F.expr(f"CASE WHEN whole >= {mix.max_epochs} THEN 0 ELSE budget - whole * tokens END")))
    join = _joiner(leaves.count())
    keyed = slim.join(join(leaves.select(*LEAF, "whole", "rest")), LEAF).where("rest > 0").withColumn("key", _key(mix, F.col("whole"), F.col("doc_id"))).withColumn("bucket", F.substring("key", 1, 3))
    order = Window.partitionBy(*LEAF).orderBy("bucket")
    sums = keyed.groupBy(*LEAF, "rest", "bucket").agg(F.sum("n_tokens").alias("t")).withColumn("upto", F.sum("t").over(order))
    edge = cut(sums.where("upto > rest AND upto - t <= rest").select(*LEAF, "bucket", (F.col("rest") - F.col("upto") + F.col("t")).alias("room")))
    running = F.sum("n_tokens").over(Window.partitionBy(*LEAF).orderBy("key").rangeBetween(Window.unboundedPreceding, 0))
    last = keyed.join(join(edge), [*LEAF, "bucket"]).withColumn("running", running).where("running <= room").groupBy(*LEAF).agg(F.max("key").alias("cut"))
    leaves = leaves.join(edge.select(*LEAF, "bucket"), LEAF, "left").join(last, LEAF, "left")
    # keys below the range of the edge are in; within it those up to the cut
    return slim, cut(leaves.select(*LEAF, "whole", "rest", F.coalesce("cut", "bucket", F.lit("")).alias("cut")))


def _joiner(leaves: int):  # noqa: ANN202
    return F.broadcast if leaves <= BROADCAST_LEAVES else lambda x: x


def _epochs(rows: DataFrame, leaves: DataFrame, mix: Mix) -> DataFrame:
    """One row for each time that a row of (doc_id, leaf...) is taken, with epoch and key."""
    both = rows.join(_joiner(leaves.count())(leaves), LEAF).where("whole > 0 OR rest > 0")
    taken = both.withColumn("epoch", F.explode(F.expr("sequence(0L, whole)"))).withColumn("key", _key(mix, F.col("epoch"), F.col("doc_id")))
    return taken.where("epoch < whole OR (rest > 0 AND key <= cut)").drop("whole", "rest", "cut")


def select(docs: DataFrame, mix: Mix | None = None) -> DataFrame:
    """(doc_id, domain, lang, source, n_tokens, epoch, key): order by (epoch, key) to read a leaf's sequence."""
    mix = mix or Mix()
    slim, leaves = plan(docs, mix)
    return _epochs(slim, leaves, mix).select("doc_id", *LEAF, "n_tokens", "epoch", "key")


def mixed(docs: DataFrame, mix: Mix | None = None) -> DataFrame:
    """The selected documents, a row for each time that one is taken: all columns of docs and mix_epoch, mix_key.

    Texts are not shuffled: the leaves' plan comes to them.
    """
    mix = mix or Mix()
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("mix_epoch", "mix_key")])
    _, leaves = plan(docs, mix)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    named = docs.select(row, F.col("doc_id"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), F.coalesce(F.col("text").rlike(TOKEN), F.lit(False)).alias("some"))
    located = named.where("some").select("row", "doc_id", mix.domain().alias("domain"), "lang", "source")
    return _epochs(located, leaves, mix).select("row.*", F.col("epoch").alias("mix_epoch"), F.col("key").alias("mix_key"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select(documents(spark, sf_dir))


def _divide_sql(source: str, parent: str, name: str, weight: str) -> str:
    family = f"PARTITION BY {parent}"
    order = f"{family} ORDER BY cap / CAST(w AS DOUBLE), {name}"
    return f"""SELECT *, CASE WHEN isfull = 1 THEN cap ELSE CAST((parent_budget - sum(CASE WHEN isfull = 1 THEN cap ELSE 0 END) OVER ({family})) * w
        // sum(CASE WHEN isfull = 0 THEN w ELSE 0 END) OVER ({family}) AS BIGINT) END AS budget
      FROM (SELECT *, min(CASE WHEN cap * rest_w <= w * rest THEN 1 ELSE 0 END) OVER ({order} ROWS UNBOUNDED PRECEDING) AS isfull
      FROM (SELECT *, parent_budget - coalesce(sum(cap) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
          sum(w) OVER ({family}) - coalesce(sum(w) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest_w
      FROM (SELECT *, CAST({weight} AS BIGINT) AS w FROM ({source})) WHERE w > 0))"""


def sql(mix: Mix | None = None) -> str:
    mix = mix or Mix()
    tops = _divide_sql("SELECT domain, sum(cap) AS cap, (SELECT sum(tokens) * {p} // 100 FROM leaves) AS parent_budget FROM leaves GROUP BY domain".format(p=mix.percent), "1", "domain", mix.weight_sql("domain", mix.domain_weights))
    langs = _divide_sql("SELECT l.domain, l.lang, sum(l.cap) AS cap, max(t.budget) AS parent_budget FROM leaves l JOIN tops t USING (domain) GROUP BY l.domain, l.lang", "domain", "lang", mix.weight_sql("lang", mix.lang_weights))
    ends = _divide_sql("SELECT l.*, g.budget AS parent_budget FROM leaves l JOIN langs g USING (domain, lang)", "domain, lang", "source", mix.weight_sql("source", mix.source_weights))
    key = f"substr(md5(concat_ws(':', '{mix.seed}', CAST(epoch AS VARCHAR), coalesce(CAST(doc_id AS VARCHAR), 'null'))), 1, 16)"
    return f"""
WITH named AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, CAST(coalesce(len(regexp_extract_all(text, '{TOKEN}')), 0) AS BIGINT) AS n_tokens FROM documents),
slim AS (SELECT doc_id, {mix.domain_sql()} AS domain, lang, source, n_tokens FROM named WHERE n_tokens > 0),
leaves AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(sum(n_tokens) * {mix.max_epochs} AS BIGINT) AS cap FROM slim GROUP BY ALL),
tops AS ({tops}), langs AS ({langs}), ends AS ({ends}),
goals AS (SELECT domain, lang, source, least(budget // tokens, {mix.max_epochs}) AS whole, CASE WHEN budget // tokens >= {mix.max_epochs} THEN 0 ELSE budget % tokens END AS rest FROM ends),
taken AS (SELECT s.*, g.whole, g.rest, CAST(unnest(range(0, CAST(g.whole AS BIGINT) + 1)) AS BIGINT) AS epoch FROM slim s JOIN goals g USING (domain, lang, source)),
keyed AS (SELECT *, {key} AS key FROM taken),
running AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source, epoch ORDER BY key RANGE UNBOUNDED PRECEDING) AS running FROM keyed)
SELECT doc_id, domain, lang, source, n_tokens, epoch, key FROM running WHERE epoch < whole OR (rest > 0 AND running <= rest)"""


SQL = sql()
