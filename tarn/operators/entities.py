"""Entity resolution: blocking, pair judging, canonical choice, folding and its reversal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.checkpoints import bounded, persisted
from tarn.functions.text import capitals, leads_with_punctuation, merge_key, name_key, name_tokens, version_tokens
from tarn.functions.vectors import cosine
from tarn.operators.components import components

SHORT_KEY, LONG_KEY, CONFIRM, MOST_EXTRA, QUEUE = 3, 8, 0.8, 2, 50


def prepared(entities: DataFrame) -> DataFrame:
    """Entities (id, name, entity_type, mentions, vec) with all that judging looks at."""
    name = F.col("name")
    return entities.select(
        "id", "name", "entity_type", "mentions", "vec", name_key(name).alias("nkey"), merge_key(name).alias("mkey"), name_tokens(name).alias("toks"),
        version_tokens(name).alias("vers"), leads_with_punctuation(name).alias("punct"), capitals(name).alias("caps"),
    )


#: Names from which on a block is crowded: only those of its pairs are made that can be more than rejected.
CROWDED = 1000


def block_pairs(entities: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """Pairs (a, b), a < b, that share the first three characters of the merge key or a token.

    Equal names are one node of the blocking: a name that many entities have costs its entities once, not squared, and
    its entities pair with one representative of each other name and with the smallest of their own. Of blocks with more than
    ``crowded`` names, the pairs that judge() would reject are left out, so they cost what their names and results are.
    """
    keyed = entities.filter("mkey <> ''")
    names = keyed.groupBy("nkey").agg(F.min("id").alias("rep"), F.first("mkey").alias("mkey"), F.first("toks").alias("toks"))
    keys = F.array_distinct(F.concat(F.array(F.concat(F.lit("p:"), F.substring("mkey", 1, 3))), F.transform("toks", lambda t: F.concat(F.lit("t:"), t))))
    blocks = names.select("rep", F.explode(keys).alias("key"))
    full = blocks.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > crowded).select("key")
    if some := not full.isEmpty():
        full = persisted(full, "crowded")
    open_ = blocks.join(bounded(full), "key", "left_anti") if some else blocks
    pairs = open_.withColumnRenamed("rep", "a").join(open_.select(F.col("rep").alias("b"), "key"), "key").filter("a < b").select("a", "b")
    if some:
        pairs = pairs.unionByName(_likely(names.join(blocks.join(bounded(full), "key", "left_semi"), "rep")))
    same = keyed.select("id", "nkey").join(names.select("nkey", "rep"), "nkey").filter("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    return pairs.distinct().unionByName(same)


def _likely(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of names (key: a block, rep, mkey, toks) of a block that are equal, one part of the other, or a few edits apart.

    Merge keys at most k edits apart have a common string that each becomes by leaving out at most k characters.
    """
    without = lambda s: F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(F.substring(s, 1, i - 1), F.substr(s, i + 1)))
    one = without(F.col("mkey"))
    two = F.when(F.length("mkey") >= LONG_KEY, F.flatten(F.transform(one, without))).otherwise(F.array().cast("array<string>"))
    left = rows.select("key", "rep", F.explode(F.array_distinct(F.concat(F.array("mkey"), one, two))).alias("s"))
    near = left.withColumnRenamed("rep", "a").join(left.withColumnRenamed("rep", "b"), ["key", "s"]).filter("a < b").select("a", "b")
    n = F.size("toks")
    part = lambda size: F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.array_join(F.slice("toks", i, size), "|"))
    sizes = F.sequence(F.greatest(F.lit(1), n - MOST_EXTRA), n)
    long = rows.select("key", F.col("rep").alias("other"), F.explode(F.array_distinct(F.flatten(F.transform(sizes, part)))).alias("s"))
    short = rows.select("key", "rep", F.array_join("toks", "|").alias("s"))
    inside = short.join(long, ["key", "s"]).filter("rep <> other").select(F.least("rep", "other").alias("a"), F.greatest("rep", "other").alias("b"))
    return near.unionByName(inside)


def _phrase(short: Column, long: Column) -> Column:
    sep = lambda t: F.concat(F.lit("|"), F.array_join(t, "|"), F.lit("|"))
    return F.contains(sep(long), sep(short))


def judge(pairs: DataFrame, entities: DataFrame) -> DataFrame:
    """Verdict (auto, review, reject), score and reason of each pair."""
    side = lambda k: entities.select(*[F.col(c).alias(f"{k}_{c}") for c in entities.columns])
    p = pairs.join(side("a"), F.col("a") == F.col("a_id")).join(side("b"), F.col("b") == F.col("b_id"))
    a, b = (lambda c: F.col(f"a_{c}")), (lambda c: F.col(f"b_{c}"))
    shorter = F.least(F.length(a("mkey")), F.length(b("mkey")))
    a_short = F.size(a("toks")) <= F.size(b("toks"))
    short, long = F.when(a_short, a("toks")).otherwise(b("toks")), F.when(a_short, b("toks")).otherwise(a("toks"))
    extra = F.size(long) - F.size(short)
    people = (F.lower(a("entity_type")) == "person") & (F.lower(b("entity_type")) == "person")
    is_phrase = (F.size(short) >= F.when(people, 1).otherwise(2)) & (extra <= MOST_EXTRA) & _phrase(short, long)
    allowed = F.when(shorter >= LONG_KEY, 2).otherwise(1)
    distance = F.levenshtein(a("mkey"), b("mkey"))
    extension = lambda x, y: F.startswith(y, F.concat(x, F.lit("."))) & F.substr(y, F.length(x) + 2).rlike("^[a-z0-9]{1,4}$")
    versions = (F.size(a("vers")) > 0).cast("int") + (F.size(b("vers")) > 0).cast("int")
    reason = (
        F.when((a("mkey") == "") | (b("mkey") == ""), "empty")
        .when((versions == 2) & ~F.arrays_overlap(a("vers"), b("vers")), "version")
        .when(versions == 1, "one_version")
        .when(extension(a("nkey"), b("nkey")) | extension(b("nkey"), a("nkey")), "extension")
        .when((a("mkey") == b("mkey")) & (F.length(a("mkey")) < SHORT_KEY), "short_key")
        .when((a("mkey") == b("mkey")) & (a("punct") != b("punct")), "punctuation")
        .when(a("mkey") == b("mkey"), "same_key")
        .when(is_phrase, "phrase")
        .when(distance <= allowed, "edit")
        .otherwise("different")
    )
    base = (
        F.when(F.col("reason") == "short_key", 0.6)
        .when(F.col("reason") == "punctuation", 0.7)
        .when(F.col("reason") == "same_key", 1.0)
        .when(F.col("reason") == "phrase", 0.75)
        .when(F.col("reason") == "edit", 0.6 + 0.15 * F.greatest(F.lit(0.0), 1 - distance / shorter))
        .otherwise(0.0)
    )
    verdict = F.when(F.col("reason") == "same_key", "auto").when(F.col("score") > 0, "review").otherwise("reject")
    raised = F.when((F.col("verdict") == "review") & (cosine(a("vec"), b("vec")) >= CONFIRM), F.least(F.lit(0.95), F.col("score") + 0.1)).otherwise(F.col("score"))
    out = p.withColumn("reason", reason).withColumn("score", base).withColumn("verdict", verdict).withColumn("score", F.round(raised, 6))
    return out.select("a", "b", "verdict", "score", "reason")


def folds(judged: DataFrame, entities: DataFrame) -> DataFrame:
    """(source, canonical) of all entities that fold: the best of each component of auto pairs takes the others."""
    member = components(judged.filter("verdict = 'auto'").select("a", "b"))
    rows = member.join(entities, member.node == entities.id)
    best = F.max_by("node", F.struct("mentions", F.length("name"), "caps", -F.col("node")))
    chosen = rows.groupBy("component").agg(best.alias("canonical"))
    return rows.join(chosen, "component").filter("node <> canonical").select(F.col("node").alias("source"), "canonical")


def fold_edges(edges: DataFrame, folded: DataFrame) -> DataFrame:
    """Edges after folding: mentions of a source go to its canonical; ones that the canonical has already go inactive."""
    to = folded.select(F.col("source").alias("to_id"), "canonical")
    moved = edges.join(to, "to_id", "left").withColumn("was", F.col("to_id")).withColumn("now", F.coalesce("canonical", "to_id"))
    first = Window.partitionBy("from_id", "now", "relation").orderBy(F.col("canonical").isNotNull(), F.desc("active"), "was")
    doomed = F.col("canonical").isNotNull() & (F.row_number().over(first) > 1)
    return moved.withColumn("doomed", doomed).select(
        "from_id",
        F.when(F.col("doomed"), F.col("was")).otherwise(F.col("now")).alias("to_id"),
        "relation",
        (F.col("active") & ~F.col("doomed")).alias("active"),
        F.when(F.col("canonical").isNotNull(), F.struct("was", "active")).alias("undo"),
    )


def unfold_edges(edges: DataFrame) -> DataFrame:
    """The edges before fold_edges()."""
    return edges.select(
        "from_id", F.coalesce("undo.was", "to_id").alias("to_id"), "relation", F.coalesce("undo.active", "active").alias("active")
    )


def review_queue(judged: DataFrame, entities: DataFrame, settled: DataFrame, most: int = QUEUE) -> DataFrame:
    """Undecided pairs by impact (mentions of the rarer side, then score); beyond ``most`` they are deferred."""
    left = judged.filter("verdict = 'review'").join(settled.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    of = lambda k: entities.select(F.col("id").alias(k), F.col("mentions").alias(f"m_{k}"))
    rows = left.join(of("a"), "a").join(of("b"), "b").withColumn("impact", F.least("m_a", "m_b"))
    # the limit comes first, so that only the queue's rows meet in one task
    queue = rows.orderBy(F.desc("impact"), F.desc("score"), "a", "b").limit(most)
    return queue.select("a", "b", "score", "reason", "impact")


def alias_chain(aliases: DataFrame) -> DataFrame:
    """(source, canonical) pointers followed to their ends; a cycle ends at its smallest member."""
    ends = components(aliases.select(F.col("source").alias("a"), F.col("canonical").alias("b")))
    targets = aliases.select(F.col("source").alias("node"))
    last = ends.join(targets, "node", "left_anti").groupBy("component").agg(F.min("node").alias("end"))
    return ends.join(last, "component", "left").select(F.col("node").alias("source"), F.coalesce("end", "component").alias("canonical")).filter("source <> canonical")
