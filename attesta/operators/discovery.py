"""Discovery: query plans, candidates from search observations, merging, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import identifiers as idn
from ..functions import text as tx
from ..functions.hashing import digest
from .bounds import at_most, while_at_most

#: What is searched for each group.
TEMPLATES = {
    "GENERAL_DENTIST": '"cirurgião-dentista" CRO',
    "DENTAL_SPECIALIST": 'dentista CRO "cirurgia facial"',
    "BUCOMAXILLOFACIAL": "bucomaxilofacial CRO",
    "HOF_OR_FACIAL_ACTIVITY": '"harmonização orofacial" CRO dentista',
}


def query_plan(states: DataFrame, groups: DataFrame, recipe: str, most: int, state: str = "state", group: str = "professional_group", template: str = "template", order: str = "group_order") -> DataFrame:
    """At most ``most`` queries of state by group, in order; both sides are short fixed lists."""
    if most < 1:
        raise ValueError("a query plan needs at least one query")
    both = states.select(F.upper(F.btrim(F.col(state))).alias("state")).distinct().join(groups)
    # a null state is the whole country
    text = F.concat_ws(" ", F.col(template), F.coalesce("state", F.lit("Brasil")))
    named = both.select("state", F.col(group).alias("professional_group"), F.col(order).alias("_o"), text.alias("query"))
    key = F.substring(digest(F.concat_ws("|", F.lit(recipe), "professional_group", F.coalesce("state", F.lit("BR")), "query")), 1, 16)
    return named.orderBy("state", "_o").limit(most).select(F.concat(F.lit("dental-query:"), key).alias("query_id"), "query", "professional_group", "state")


def observed(items: DataFrame, queries: DataFrame, items_query: str = "query", results: str = "organic_results") -> DataFrame:
    """Search hits with the query they answer, looked up by folded text; of equal queries the last id counts."""
    fold = lambda c: tx.casefolded(tx.collapse(c))
    known = queries.groupBy(fold(F.col("query")).alias("_k")).agg(F.max("query_id").alias("query_id"))
    hits = items.select("*", F.posexplode(results).alias("position", "hit")).withColumn("_k", fold(F.col(items_query)))
    return hits.join(known, "_k", "left").drop("_k", results)


def answered(items: DataFrame, queries: DataFrame, max_queries: int, max_items: int, results: str = "organic_results") -> DataFrame:
    """As :func:`observed` for one batch of a provider, whose bounds fail the query and never cut it."""
    bounded = while_at_most(at_most(items, max_items, "max_dataset_items"), queries, max_queries, "max_queries")
    return observed(bounded, queries, results=results)


def candidates(observations: DataFrame, recipe: str, title: str = "title", snippet: str = "snippet", url: str = "url") -> DataFrame:
    """Observations with a registration, a group or a facial term; others are left out."""
    text = F.concat_ws("\n", F.coalesce(title, F.lit("")), F.coalesce(snippet, F.lit("")))
    read = observations.withColumn("_t", text).withColumn("_f", tx.folded_rule(F.col("_t"))).withColumn("_r", tx.registration(F.col("_t")))
    read = read.withColumn("observed_professional_group", tx.group_class(F.col("_f"))).withColumn("facial_relevance_terms", tx.facial_terms(F.col("_f")))
    some = read.where(F.col("_r").isNotNull() | F.col("observed_professional_group").isNotNull() | (F.size("facial_relevance_terms") > 0))
    some = some.withColumn("source_url", idn.normalized_url(F.col(url), idn.RESULT_URL))
    key = F.coalesce(F.concat_ws(":", F.col("_r.state"), F.col("_r.number")), F.col("source_url"))
    key = F.when(F.col("_r").isNotNull(), key).otherwise(F.col("source_url"))
    return some.select(
        *[c for c in observations.columns if c not in ("source_url",)],
        F.concat(F.lit("dental-candidate:"), F.substring(digest(F.concat_ws("|", F.lit(recipe), key)), 1, 20)).alias("candidate_id"),
        F.btrim(F.col(title)).alias("display_name_hint"),
        "source_url",
        F.col("_r.state").alias("cro_state"),
        F.col("_r.number").alias("cro_number"),
        "observed_professional_group",
        "facial_relevance_terms",
    )


def merged(found: DataFrame, key: str, order: str, first: list[str], first_known: list[str], union: list[str]) -> DataFrame:
    """One row for each key: first values, first values that are known, and unions of lists.

    All are aggregates with map-side combining.
    """
    known = [F.min_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in first_known]
    return found.groupBy(key).agg(
        F.min(order).alias(order),
        *[F.min_by(c, order).alias(c) for c in first],
        *known,
        *[F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in union],
    )


def merge_key(state: Column, number: Column, url: Column) -> Column:
    return F.coalesce(idn.council_key(state, number), F.concat(F.lit("URL:"), url))


def coverage(reference: DataFrame, discovered: DataFrame, key: str) -> DataFrame:
    """Matches, misses, surplus, repeats, precision (null if nothing was found) and recall."""
    ref = reference.select(F.col(key)).distinct().withColumn("_r", F.lit(1))
    got = discovered.groupBy(key).agg(F.count("*").alias("_n"))
    both = ref.join(got, key, "full")
    is_ref, is_got = F.col("_r").isNotNull(), F.col("_n").isNotNull()
    counted = both.agg(
        F.count_if(is_ref).alias("reference_count"),
        F.count_if(is_got).alias("discovered_count"),
        F.count_if(is_ref & is_got).alias("matched"),
        F.count_if(is_ref & ~is_got).alias("missed"),
        F.count_if(~is_ref & is_got).alias("unexpected"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_observations"),
    )
    m = F.col("matched")
    return counted.withColumn("precision", F.try_divide(m, F.col("discovered_count"))).withColumn("coverage", F.coalesce(F.try_divide(m, F.col("reference_count")), F.lit(0.0)))


def acquired(seeds: DataFrame, responses: DataFrame, key: str) -> DataFrame:
    """Each seed with its response or the reason it has none: errors are data."""
    out = seeds.join(responses.withColumn("_there", F.lit(True)), key, "left")
    ok = F.col("_there").isNotNull() & F.col("error_type").isNull() if "error_type" in responses.columns else F.col("_there").isNotNull()
    return out.withColumn("succeeded", ok).drop("_there")


def acquisition_counts(rows: DataFrame) -> DataFrame:
    """Seeds tried, acquired and not, of rows as from :func:`acquired`."""
    return rows.agg(F.count("*").alias("attempted"), F.count_if("succeeded").alias("succeeded"), F.count_if(~F.col("succeeded")).alias("failed"))
