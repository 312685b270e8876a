"""Company resolution: blocking, features, decisions, triage and evaluation.

Pairs come from an equi-join on blocking keys, never from all pairs. Features
and decisions are columns over pairs. There is no transitive closure: the
outcome is a disposition for each pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import identifiers as idn
from ..functions import text as tx
from ..sources import scratch
from . import bounds as bd

#: Weights of the features, and the name similarity that exact evidence needs.
WEIGHTS = {"name_similarity": 0.40, "domain_exact": 0.25, "phone_exact": 0.15, "address_similarity": 0.10, "location_exact": 0.05, "cnae_exact": 0.05}
NAME_WITH_DOMAIN, NAME_WITH_PHONE, NAME_WITH_TWO = 0.72, 0.78, 0.62
THRESHOLD = 0.78


def prepared(records: DataFrame, id_col: str = "record_id") -> DataFrame:
    """Records with what features and keys compare, computed once for each record.

    Columns name, registry_namespace, registry_id, domain, phone, address, city,
    state and cnae may be null, or absent.
    """
    c = lambda n: F.col(n).cast("string") if n in records.columns else F.lit(None).cast("string")
    return records.select(
        F.col(id_col).alias("record_id"),
        tx.folded_entity(c("name")).alias("name"),
        idn.registry_of(c("registry_namespace"), c("registry_id")).alias("registry"),
        idn.checked_domain(tx.clean(c("domain")))["value"].alias("domain"),
        idn.phone_rule(tx.clean(c("phone"))).alias("phone"),
        tx.tokens(tx.folded_entity(c("address"))).alias("address"),
        tx.folded_entity(c("city")).alias("city"),
        tx.folded_entity(c("state")).alias("state"),
        F.nullif(idn.digits(c("cnae")), F.lit("")).alias("cnae"),
    )


def keys() -> Column:
    """Blocking keys of a prepared record."""
    prefix = F.substring(F.get(tx.tokens(F.col("name")), 0), 1, 6)
    some = F.array(
        F.concat(F.lit("registry:br:cnpj:"), F.col("registry")),
        F.concat(F.lit("domain:"), F.col("domain")),
        F.concat(F.lit("phone:"), F.col("phone")),
        F.concat(F.lit("name0:"), prefix),
        F.concat(F.lit("name0_city:"), prefix, F.lit(":"), F.col("city")),
    )
    return F.array_distinct(F.array_compact(some))


#: Records of one key that meet in one cell; a key with more has a square of cells.
CELL = 512
#: Records for one task of a join or a sort, so that a task's memory does not grow with the table.
ROWS = 40_000
#: Keys of one record in :func:`partners`, which counts under each set of them.
MOST_KEYS = 8


def tasks(records: DataFrame) -> int:
    """How many tasks some records are worth; the rows are counted, and nothing else of them is computed."""
    return max(records.sparkSession.sparkContext.defaultParallelism, -(-records.count() // ROWS))


def _key_sets(records: DataFrame, id_col: str, keys_col: str, n: int) -> DataFrame:
    """(id, keys) of each record, its keys once and in order."""
    each = records.select(F.col(id_col).alias("id"), F.explode(keys_col).alias("key")).where("id is not null and key is not null").repartition(n, "id")
    return each.groupBy("id").agg(F.array_sort(F.collect_set("key")).alias("keys"))


def partners(records: DataFrame, id_col: str = "record_id", keys_col: str = "keys") -> DataFrame:
    """(left_id, partners, first_partner, last_partner): how many greater ids share a key with each, the least and the greatest.

    What :func:`blocked_pairs` gives by left_id, without a pair being made: records
    that share several keys are counted under each set of keys that a record has, with
    changing signs. The ids under a set are ordered over all tasks and a record knows
    how many come after it, so the work grows with the records, whatever a key's size.
    A record of more than MOST_KEYS keys is an error.
    """
    n = tasks(records)
    each = bd.required(_key_sets(records, id_col, keys_col, n), f"a record has at most {MOST_KEYS} keys", F.size("keys") <= MOST_KEYS, F.col("id"))
    each = each.select("id", "keys", F.explode(F.expr("sequence(1, shiftleft(1, size(keys)) - 1)")).alias("mask"))
    each = each.select("id", F.expr("filter(keys, (k, i) -> shiftright(mask, i) % 2 = 1)").alias("held"))
    # a table, as another run of the same plan may cut the ranges elsewhere
    table = scratch.folder(records.sparkSession, "ranks")
    each.repartitionByRange(4 * n, "held", "id").withColumn("part", F.spark_partition_id()).write.parquet(table)
    placed = records.sparkSession.read.parquet(table).repartition(4 * n, "held", "part")
    own = Window.partitionBy("held", "part").orderBy("id")
    placed = placed.select("*", F.row_number().over(own).alias("nth"), F.lead("id").over(own).alias("next"))
    sums = placed.groupBy("held", "part").agg(F.count("*").alias("n"), F.min("id").alias("least"), F.max("id").alias("most")).repartition(4 * n, "held")
    later = Window.partitionBy("held").orderBy(F.desc("part"))
    sums = sums.select(
        "held", "part", "n", F.coalesce(F.sum("n").over(later.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("after"), F.lag("least").over(later).alias("other"), F.max("most").over(Window.partitionBy("held")).alias("most")
    )
    both = placed.join(sums.repartition(4 * n, "held", "part"), ["held", "part"]).withColumn("after", F.col("n") - F.col("nth") + F.col("after")).where("after > 0")
    one, odd = F.size("held") == 1, F.size("held") % 2 == 1
    return both.groupBy(F.col("id").alias("left_id")).agg(
        F.sum(F.when(odd, F.col("after")).otherwise(-F.col("after"))).alias("partners"), F.min(F.when(one, F.coalesce("next", "other"))).alias("first_partner"), F.max(F.when(one, F.col("most"))).alias("last_partner")
    )


def blocked_pairs(records: DataFrame, id_col: str = "record_id", keys_col: str = "keys", cell: int = CELL) -> DataFrame:
    """(left_id, right_id) of records that share a key, each pair once, however large a key is.

    Keys are counted first. The n records of a large key are dealt to c cells by
    a hash of their id, and every two cells meet under a key of their own, so no
    task has more than some cell * cell pairs, and a record is sent c times. A pair
    comes from the smallest key that it shares, so pairs need no distinct. Rows that
    repeat an id are one record with the keys of all.
    """
    n = tasks(records)
    each = _key_sets(records, id_col, keys_col, n).select("id", "keys", F.explode("keys").alias("key"))
    # of the others only the smaller ones say whether a pair comes from another key
    each = each.select("id", "key", F.filter("keys", lambda k: k < F.col("key")).alias("keys")).repartition(n, "key")
    large = each.groupBy("key").agg(F.count("*").alias("_n")).where(F.col("_n") > cell).select("key", F.ceil(F.col("_n") / cell).cast("int").alias("cells"))
    placed = each.join(large, "key", "left").withColumn("cells", F.coalesce("cells", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("id"), F.col("cells")).cast("int"))
    # the pair of cells (i, j) with i <= j
    a = placed.select("key", F.col("own").alias("i"), F.explode(F.sequence("own", F.col("cells") - 1)).alias("j"), F.col("id").alias("a"), F.col("keys").alias("ka"))
    b = placed.select("key", F.explode(F.sequence(F.lit(0), F.col("own"))).alias("i"), F.col("own").alias("j"), F.col("id").alias("b"), F.col("keys").alias("kb"))
    a, b = (x.repartition(n, "key", "i", "j") for x in (a, b))
    both = a.join(b, ["key", "i", "j"]).where((F.col("i") < F.col("j")) | (F.col("a") < F.col("b")))
    both = both.where(~F.arrays_overlap("ka", "kb"))
    return both.select(F.least("a", "b").alias("left_id"), F.greatest("a", "b").alias("right_id"))


def with_sides(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """Pairs with both prepared records as structs l and r."""
    n = tasks(records)
    left = records.select(F.col("record_id").alias("left_id"), F.struct("*").alias("l"))
    right = records.select(F.col("record_id").alias("right_id"), F.struct("*").alias("r"))
    found = pairs.repartition(2 * n, "left_id").join(left.repartition(2 * n, "left_id"), "left_id")
    return found.repartition(2 * n, "right_id").join(right.repartition(2 * n, "right_id"), "right_id")


def features(pairs: DataFrame, similarity: bool = True) -> DataFrame:
    """Pairs (with l and r) and their features; null is not comparable.

    ``similarity=False`` leaves the sequence ratio out, so all is built in.
    """
    same = lambda c: F.col(f"l.{c}") == F.col(f"r.{c}")
    overlap = F.coalesce(tx.jaccard(tx.tokens(F.col("l.name")), tx.tokens(F.col("r.name"))), F.lit(0.0))
    both = F.col("l.name").isNotNull() & F.col("r.name").isNotNull()
    name = tx.name_similarity(F.col("l.name"), F.col("r.name")) if similarity else F.when(both, overlap)
    return pairs.select(
        "*",
        F.coalesce(same("registry"), F.lit(None)).isNotNull().alias("registry_comparable"),
        same("registry").alias("registry_exact"),
        F.coalesce(~same("registry"), F.lit(False)).alias("registry_conflict"),
        same("domain").alias("domain_exact"),
        same("phone").alias("phone_exact"),
        name.alias("name_similarity"),
        tx.jaccard(F.col("l.address"), F.col("r.address")).alias("address_similarity"),
        F.when(
            F.col("l.city").isNotNull() & F.col("r.city").isNotNull() & F.col("l.state").isNotNull() & F.col("r.state").isNotNull(),
            same("city") & same("state"),
        ).alias("location_exact"),
        same("cnae").alias("cnae_exact"),
    )


def weighted() -> Column:
    """The weighted mean of the features that are known; zero if none is."""
    known = [(w, F.col(c).cast("double")) for c, w in WEIGHTS.items()]
    total = sum((F.when(v.isNotNull(), w).otherwise(0.0) for w, v in known), F.lit(0.0))
    score = sum((F.coalesce(v * w, F.lit(0.0)) for w, v in known), F.lit(0.0))
    return F.coalesce(F.try_divide(score, total), F.lit(0.0))


def exact_evidence() -> Column:
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    name = F.coalesce(F.col("name_similarity"), F.lit(0.0))
    exact = sum((yes(c).cast("int") for c in ("domain_exact", "phone_exact", "location_exact")), F.lit(0))
    return (yes("domain_exact") & (name >= NAME_WITH_DOMAIN)) | (yes("phone_exact") & (name >= NAME_WITH_PHONE)) | ((exact >= 2) & (name >= NAME_WITH_TWO))


def _decided(otherwise: Column, conflict, same) -> Column:
    return F.when(F.col("registry_conflict"), conflict).when(F.coalesce(F.col("registry_exact"), F.lit(False)), same).otherwise(otherwise)


def matched(strategy: str, threshold: float = THRESHOLD) -> Column:
    """Whether a pair is one company by REGISTRY_ONLY, EXACT_EVIDENCE or WEIGHTED."""
    rule = {"REGISTRY_ONLY": F.lit(False), "EXACT_EVIDENCE": exact_evidence(), "WEIGHTED": weighted() >= threshold}[strategy]
    return _decided(rule, F.lit(False), F.lit(True))


def score(strategy: str) -> Column:
    rule = {"REGISTRY_ONLY": F.lit(0.0), "EXACT_EVIDENCE": exact_evidence().cast("double"), "WEIGHTED": weighted()}[strategy]
    return _decided(rule, F.lit(0.0), F.lit(1.0))


def evidence_reasons() -> Column:
    own = [F.when(F.coalesce(F.col(c), F.lit(False)), c) for c in ("domain_exact", "phone_exact", "location_exact")]
    name = F.when(F.coalesce(F.col("name_similarity"), F.lit(0.0)) > 0, F.format_string("name=%.3f", F.col("name_similarity")))
    return F.array_compact(F.array(*own, name))


def triage() -> Column:
    """struct<disposition, reasons>; the weighted score has no say."""
    out = lambda d, *r: F.struct(F.lit(d).alias("disposition"), F.array(*map(F.lit, r)).alias("reasons"))
    review = F.struct(F.lit("REVIEW").alias("disposition"), evidence_reasons().alias("reasons"))
    rule = F.when(exact_evidence(), review).otherwise(out("INSUFFICIENT_EVIDENCE", "no_v1_auto_match_or_review_rule"))
    return _decided(rule, out("DISTINCT", "registry_conflict"), out("AUTO_MATCH", "registry_exact"))


def triaged(pairs: DataFrame) -> DataFrame:
    """Pairs (with l and r) with their features, ``disposition``, ``reasons`` and ``verified``.

    The sequence ratio is computed for those pairs alone whose disposition it can
    still change: no registry decides, some other field is equal, and what the
    lengths and letters of both names allow reaches the threshold. The name
    similarity of the others is null.
    """
    known = features(pairs, similarity=False).withColumnRenamed("name_similarity", "name_overlap")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    two = sum((yes(c).cast("int") for c in ("domain_exact", "phone_exact", "location_exact")), F.lit(0)) >= 2
    least = F.least(F.when(yes("domain_exact"), NAME_WITH_DOMAIN), F.when(yes("phone_exact"), NAME_WITH_PHONE), F.when(two, NAME_WITH_TWO))
    open_ = ~yes("registry_conflict") & ~yes("registry_exact")
    l, r = F.col("l.name"), F.col("r.name")
    # letters are counted only where lengths leave it open
    reach = F.coalesce(tx.similarity_bound(l, r, F.col("name_overlap"), least) >= least, F.lit(False))
    known = known.withColumn("verified", open_ & F.coalesce(least, F.lit(9.0)).between(0, 1) & reach)
    one = F.when(F.col("verified"), l), F.when(F.col("verified"), r)
    found = known.withColumn("name_similarity", tx.name_similarity(*one)).withColumn("_t", triage())
    return found.select("*", "_t.disposition", "_t.reasons").drop("_t")


# --- evaluation --------------------------------------------------------------


def confusion(pairs: DataFrame, truth: Column, predicted: Column, by: list[str] = ()) -> DataFrame:  # type: ignore[assignment]
    """Counts, precision, recall, F1 and false-merge rate; zero where undefined."""
    count = lambda c: F.count_if(c)
    counted = pairs.groupBy(*by).agg(
        count(truth & predicted).alias("tp"), count(~truth & predicted).alias("fp"), count(~truth & ~predicted).alias("tn"), count(truth & ~predicted).alias("fn")
    )
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    rated = counted.withColumn("precision", share(tp, tp + fp)).withColumn("recall", share(tp, tp + fn))
    p, r = F.col("precision"), F.col("recall")
    return rated.withColumn("f1", share(2 * p * r, p + r)).withColumn("false_merge_rate", share(fp, fp + tn))


def blocking_quality(candidates: DataFrame, truth: DataFrame, records: int | Column, ends: list[str] = ("left_id", "right_id")) -> DataFrame:  # type: ignore[assignment]
    """Recall over true pairs and reduction over all pairs, which are counted by formula."""
    ends = list(ends)
    hit = candidates.join(truth.select(*ends).distinct().withColumn("_t", F.lit(True)), ends, "left")
    n = (records if isinstance(records, Column) else F.lit(records)).cast("long")
    # the even one of n and n - 1 is halved first, so nothing goes beyond a long that the result fits in
    total = F.when(n % 2 == 0, F.shiftright(n, 1) * (n - 1)).otherwise(n * F.shiftright(n - 1, 1))
    counted = hit.agg(F.count("*").alias("candidate_pairs"), F.count("_t").alias("candidate_duplicate_pairs"))
    known = truth.select(*ends).distinct().agg(F.count("*").alias("true_duplicate_pairs"))
    out = counted.join(known).withColumn("total_pairs", total)
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return out.withColumn("blocking_recall", share("candidate_duplicate_pairs", "true_duplicate_pairs")).withColumn(
        "reduction_ratio", F.when(F.col("total_pairs") > 0, 1 - F.col("candidate_pairs") / F.col("total_pairs")).otherwise(0.0)
    )
