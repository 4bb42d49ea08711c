"""Text, search and quality queries over documents, pages and members."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanwright.functions.columns import is_present, name_prefixes, normalize_for_match, token_count
from spanwright.operators import textsearch as T
from spanwright.plans.catalogue import cur
from spanwright.plans.registry import CUR, PRESENT, Registry
from spanwright.runtime import table

query = Registry()
P = PRESENT.format


@query("SELECT doc_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS norm FROM documents")
def normalized_text(s, d):
    return table(s, d, "documents").select("doc_id", normalize_for_match("text").alias("norm"))


@query(f"WITH {CUR} SELECT id, coalesce({P('docstring')}, false) AS documented, coalesce({P('primary_api_name')}, false) AS named FROM cur")
def presence_check(s, d):
    f = F.lit(False)
    return cur(s, d, "docstring", "primary_api_name").select("id", F.coalesce(is_present("docstring"), f).alias("documented"), F.coalesce(is_present("primary_api_name"), f).alias("named"))


@query("SELECT doc_id, CASE WHEN trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) END AS words FROM documents")
def token_counts(s, d):
    return table(s, d, "documents").select("doc_id", token_count("text").cast("long").alias("words"))


@query("SELECT doc_id, CASE WHEN length(text) > 0 THEN (length(text) - length(replace(text, 'tile', ''))) // 4 ELSE 0 END AS hits, coalesce(round(((length(text) - length(replace(text, 'tile', ''))) // 4) * 1000.0 / nullif(length(text), 0), 6), 0.0)::DOUBLE AS per_1000 FROM documents")
def needle_density(s, d):
    return T.density(table(s, d, "documents"), "tile")


@query(f"WITH {CUR}, n AS (SELECT DISTINCT name AS needle FROM cur WHERE member_type = 'class'), w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z_0-9]*')) AS needle FROM documents) SELECT doc_id, needle, count(*) AS n FROM w WHERE needle IN (SELECT needle FROM n) GROUP BY 1, 2")
def needle_hits(s, d):
    """Which documents name which class, and how often."""
    names = cur(s, d, "name", "member_type").where("member_type = 'class'").select(F.col("name").alias("needle"))
    return T.needle_hits(table(s, d, "documents"), names)


@query("WITH q AS (SELECT * FROM embeddings WHERE vec_id % 20 = 0), x AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9) AS score FROM q, embeddings e WHERE q.vec_id <> e.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM x) SELECT query_id, vec_id, round(score, 6) AS score, rank::INT AS rank FROM r WHERE rank <= 5")
def cosine_topk(s, d):
    """The five nearest vectors of every twentieth one, against all."""
    v = table(s, d, "embeddings")
    return T.nearest(v, v.where("vec_id % 20 = 0"), 5).withColumn("score", F.round("score", 6))


@query(f"WITH {CUR}, x AS (SELECT c.id, unnest(range(1, len(string_split(fully_qualified_name, '.')) + 1)) AS k, string_split(fully_qualified_name, '.') AS p FROM cur c WHERE fully_qualified_name IS NOT NULL) SELECT array_to_string(p[1:k], '.') AS prefix, count(*) AS n FROM x GROUP BY 1")
def prefix_counts(s, d):
    """How many members lie at or below every dotted prefix."""
    return cur(s, d, "fully_qualified_name").where("fully_qualified_name is not null").select(F.explode(name_prefixes("fully_qualified_name")).alias("prefix")).groupBy("prefix").agg(F.count("*").alias("n"))


@query("WITH e AS (SELECT *, epoch_us(ts) - epoch_us(lag(ts) OVER w) AS gap FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)), g AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 3600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS burst FROM e) SELECT user_id, event_type, max(ts) AS fired_at, arg_max(event_id, (ts, event_id)) AS event_id, count(*) AS n_events FROM g GROUP BY user_id, event_type, burst")
def debounced_events(s, d):
    """Only the last event of a burst fires: events of a key closer than an hour to the one before belong together."""
    from spanwright.streaming.debounce import debounced

    return debounced(table(s, d, "events"), "1 hour")


@query("SELECT event_type, json_extract(props, '$.k')::BIGINT AS k, count(*) AS n, round(sum(value), 4)::DOUBLE AS total FROM events GROUP BY 1, 2")
def json_props_agg(s, d):
    e = table(s, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return e.groupBy("event_type", "k").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT lang, source, count(*) AS n, sum(n_chars) AS chars FROM documents GROUP BY ROLLUP (lang, source)")
def document_rollup(s, d):
    return table(s, d, "documents").rollup("lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("SELECT regexp_replace(lower(trim(source)), '[ _-]+', '_', 'g') AS source, count(*) AS n, median(n_chars)::DOUBLE AS median_chars, round(stddev_pop(n_chars), 4)::DOUBLE AS sd FROM documents GROUP BY 1")
def source_lengths(s, d):
    return table(s, d, "documents").groupBy(F.regexp_replace(F.lower(F.trim("source")), "[ _-]+", "_").alias("source")).agg(F.count("*").alias("n"), F.median("n_chars").alias("median_chars"), F.round(F.stddev_pop("n_chars"), 4).alias("sd"))


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity)::DOUBLE AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2)::DOUBLE AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def pricing_summary(s, d):
    l = table(s, d, "lineitem").where("l_shipdate <= timestamp '1998-09-02'")
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query("SELECT n.n_name AS nation, count(DISTINCT o.o_orderkey) AS n_orders, round(sum(l.l_extendedprice * (1 - l.l_discount)), 2)::DOUBLE AS revenue FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY 1")
def revenue_by_nation(s, d):
    """Lines are summed per order before they meet customers, so the second shuffle carries one row per order."""
    per = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    o = table(s, d, "orders").select("o_orderkey", "o_custkey").join(per, "o_orderkey")
    c = table(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    n = table(s, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("nation"))
    return o.join(c, "o_custkey").join(n, "c_nationkey").groupBy("nation").agg(F.count("*").alias("n_orders"), F.round(F.sum("r"), 2).alias("revenue"))


QUERIES, ORACLES = query.queries, query.oracles
