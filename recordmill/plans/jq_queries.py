"""jq programs over the tables, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordmill.functions.order import variant_key
from recordmill.plans.jq.compiler import interpreted, jq
from recordmill.plans.search_queries import read
from recordmill.sources.records import with_positions


def docs(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")


def events(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", "event_type", "user_id", "value", F.from_json("props", "k long").alias("data"))


def orders(spark, sf_dir):
    """Customers with their orders nested."""
    rows = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status")))).alias("orders"))
    return rows.select(F.col("o_custkey").alias("id"), "orders")


def over(table, program, *order):
    return lambda spark, sf_dir: jq(table(spark, sf_dir), program, *order)


def values(found, shape):
    """The fields of a program's JSON results."""
    return found.select(F.from_json("value", shape).alias("v")).select("v.*")


def places(spark, sf_dir):
    """Regions and nations as one stream of records."""
    regions = read(spark, sf_dir, "region").select(F.lit("region").alias("t"), F.col("r_regionkey").alias("key"), F.col("r_name").alias("name"), F.lit(None).cast("int").alias("region"))
    return regions.unionByName(read(spark, sf_dir, "nation").select(F.lit("nation").alias("t"), F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")))


def jq_index_join(spark, sf_dir):
    """INDEX over the regions of a stream, and each nation looked up in it."""
    program = '[., inputs] | INDEX(.[] | select(.t == "region"); .key) as $r | .[] | select(.t == "nation") | {id: .key, name: $r[.region | tostring].name}'
    return jq(places(spark, sf_dir), program, "t", "key").select(F.col("id").cast("long").alias("id"), "name")


def mixed(spark, sf_dir):
    """Documents with a field of several types: null, booleans, numbers, text, arrays and objects."""
    n = F.col("doc_id") % 7
    text = (
        F.when(n == 0, "null").when(n == 1, F.when(F.col("n_chars") % 2 == 0, "true").otherwise("false")).when(n == 2, F.col("n_chars").cast("string")).when(n == 3, F.concat(F.lit('"'), "lang", F.lit('"')))
        .when(n == 4, F.concat(F.lit("["), F.col("n_chars") % 3, F.lit(', "'), "lang", F.lit('"]'))).when(n == 5, F.concat(F.lit('{"lang": "'), "lang", F.lit('", "n": '), F.col("n_chars") % 3, F.lit("}"))).otherwise(F.concat(F.col("n_chars") % 5, F.lit(".5")))
    )
    return docs(spark, sf_dir).select("doc_id", F.parse_json(text).alias("v"))


def jq_mixed_sort(spark, sf_dir):
    """Every document's place in jq's order over all types, numbered by ranges."""
    rows = mixed(spark, sf_dir).select("doc_id", variant_key(F.col("v")).alias("key"))
    return with_positions(rows, "key", "doc_id", name="place").select("doc_id", "place")


def jq_mixed_group(spark, sf_dir):
    """Groups by a field of several types, with how many each has and the first."""
    return jq(mixed(spark, sf_dir), "[., inputs] | group_by(.v) | map({n: length, first: (map(.doc_id) | min)})")


def jq_mixed_compare(spark, sf_dir):
    """Values beyond all numbers up to 2 and before objects: comparisons over types."""
    return jq(mixed(spark, sf_dir), 'select(.v > 2 and .v <= "fr" or .v == true or .v.n == 1) | {doc_id}')


def jq_join(spark, sf_dir):
    """JOIN of orders with an index of customers, from one stream of both; both sides are at hand."""
    customers = read(spark, sf_dir, "customer").select(F.lit("customer").alias("t"), F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.lit(None).cast("long").alias("customer"))
    orders = read(spark, sf_dir, "orders").select(F.lit("order").alias("t"), F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("name"), F.col("o_custkey").cast("long").alias("customer"))
    program = '[., inputs] | INDEX(.[] | select(.t == "customer"); .key) as $c | JOIN($c; .[] | select(.t == "order"); .customer | tostring; {key: .[0].key, status: .[0].name, customer: .[1].name})'
    return jq(customers.unionByName(orders), program, "t", "key")


def jq_in_stream(spark, sf_dir):
    """Documents in a language that some long document has, and from a source that no short one has: lists of the stream."""
    program = '[., inputs] | [.[] | select(.n_chars > 10000) | .lang] as $long | [.[] | select(.n_chars < 20) | .source] as $short | .[] | select((.lang | IN($long[])) and (.source | IN($short[]) | not)) | {doc_id, lang}'
    return jq(docs(spark, sf_dir), program)


def jq_foreach_stream(spark, sf_dir):
    """A running sum over all events in their order, by ranges."""
    return jq(events(spark, sf_dir), "foreach (., inputs) as $e (0; . + $e.user_id; {event_id: $e.event_id, running: .})", "event_id")


def jq_range(spark, sf_dir):
    """A row for each line of a nation's key, counted by range."""
    return jq(read(spark, sf_dir, "nation"), ".n_name as $name | .n_nationkey as $n | range($n) | select(. % 2 == 0) | {name: $name, i: .}")


def jq_limit_items(spark, sf_dir):
    """The first two orders of each customer."""
    return jq(orders(spark, sf_dir), ".id as $id | limit(2; .orders[]) | {id: $id, key: .key}")


def jq_def_arguments(spark, sf_dir):
    """Functions with values and closures as arguments, put in place of their calls."""
    program = 'def of($s): [.[] | select(.status == $s) | .key] | add // 0; def twice(f): f + f; {id, open: (.orders | of("O")), done: (.orders | of("F")), more: (.orders | twice(length))}'
    return jq(orders(spark, sf_dir), program)


def jq_in_semi(spark, sf_dir):
    return jq(docs(spark, sf_dir), 'select(.lang | IN("en", "de")) | select(.source | IN("src1", "src2", "src3")) | {doc_id}')


def jq_foreach_running(spark, sf_dir):
    """A running sum over each customer's orders, each of its states."""
    program = '.id as $id | foreach .orders[] as $o (0; . + $o.key; {id: $id, key: $o.key, running: .})'
    return jq(orders(spark, sf_dir), program)


def jq_cross(spark, sf_dir):
    program = "[[.r_name], [1, 2, 3]] | combinations | {r_name: .[0], n: .[1]}"
    return values(interpreted(read(spark, sf_dir, "region"), program), "r_name string, n long")


def jq_transpose(spark, sf_dir):
    program = "[[.n_nationkey, .n_regionkey], [.n_name]] | transpose | {a: .[0][0], b: .[0][1], c: .[1][1], d: (.[1][0])}"
    return values(interpreted(read(spark, sf_dir, "nation"), program), "a long, b string, c string, d long")


def jq_entries(spark, sf_dir):
    program = ".event_id as $id | .data | to_entries[] | {event_id: $id, key, value}"
    return values(interpreted(events(spark, sf_dir).where("data is not null"), program), "event_id long, key string, value long")


def jq_with_entries(spark, sf_dir):
    program = 'with_entries(select(.key | startswith("n_")) | .key |= ltrimstr("n_")) | {key: .nationkey, names: (keys | join(",")), up: (map_values(tostring) | .regionkey)}'
    return values(interpreted(read(spark, sf_dir, "nation"), program), "key long, names string, up string")


def jq_array_setops(spark, sf_dir):
    """Arrays added to and taken from each other."""
    program = "(.orders | map(.key)) as $k | {id, more: ($k + [0, 0] | length), less: ($k - [$k[0]] | length), open: ([.orders[] | select(.status == \"O\") | .key] - $k | length)}"
    return values(interpreted(orders(spark, sf_dir), program), "id long, more long, less long, open long")


def jq_catch(spark, sf_dir):
    program = 'try (if .doc_id % 3 == 0 then error("third") else {doc_id, said: "fine"} end) catch {doc_id: -1, said: .}'
    return values(interpreted(docs(spark, sf_dir), program), "doc_id long, said string")


def jq_break(spark, sf_dir):
    """The first order of each customer past a key, found by leaving a loop; contains and inside beside it."""
    program = '.id as $id | label $f | .orders[] | select(.key > 100) | {id: $id, key, in: ({status} | inside({status: "O", key: 1})), has: (.status | contains("P"))}, break $f'
    return values(interpreted(orders(spark, sf_dir), program), "id long, key long, in boolean, has boolean")


def jq_leaf_paths(spark, sf_dir):
    """How many leaf paths nested records have, counted along their type."""
    return jq(orders(spark, sf_dir), "{id, n: ([leaf_paths] | length)}")


def jq_fallback(spark, sf_dir):
    """A program with functions, reductions and strings, row by row."""
    program = 'def f($s): [.[] | select(.status == $s) | .key] | add // 0; {id, f: (.orders | f("F")), o: (.orders | f("O")), label: "c\\(.id)"} | [.id, .f, .o, .label] | @tsv'
    found = interpreted(orders(spark, sf_dir), program)
    cells = F.split(F.from_json(F.concat(F.lit('{"v":'), "value", F.lit("}")), "v string")["v"], "\t")
    return found.select(cells[0].cast("long").alias("id"), cells[1].cast("long").alias("f"), cells[2].cast("long").alias("o"), cells[3].alias("label"))


def jq_def(spark, sf_dir):
    """A function of its own, put in place of its call."""
    return jq(docs(spark, sf_dir), "def f: {doc_id, twice: (.n_chars * 2)}; f")


QUERIES = {
    "jq_path": over(events, "{id: .event_id, k: .data.k}"),
    "jq_object": over(docs, '{ref: (.source + ":" + (.doc_id | tostring)), lang, half: (.n_chars / 2)}'),
    "jq_select": over(docs, 'select(.lang == "en" and (.n_chars > 1000 or .source != "src1") and (.doc_id % 2 == 0 | not)) | {doc_id}'),
    "jq_comma": over(docs, ".lang, .source"),
    "jq_explode": over(orders, '.orders[]? | select(.status != "F") | {key, status}'),
    "jq_binding": over(orders, '. as $r | .orders[] | select(.status == "P") | {id: $r.id, key: .key}'),
    "jq_any": over(orders, 'select(any(.orders[]; .status == "P") and (all(.orders[]; .key > 100))) | {id}'),
    "jq_if": over(docs, '{doc_id, size: (if .n_chars < 500 then "small" elif .n_chars < 2000 then "middle" else "large" end)}'),
    "jq_alternative": over(events, '{id: .event_id, k: (.data.k // 0), missing: (.data.none // "none")}'),
    "jq_has": over(docs, 'select(has("lang") and (has("nothing") | not) and (.source | startswith("src1"))) | {doc_id}'),
    "jq_del": over(docs, 'del(.source, .n_chars) | .lang |= ascii_upcase | .doc_id += 1'),
    "jq_group_by": over(docs, "[., inputs] | group_by(.lang) | map({lang: .[0].lang, n: length, chars: (map(.n_chars) | add), most: (map(.n_chars) | max)})"),
    "jq_aggs": over(events, "[., inputs] | group_by([.event_type, .user_id]) | map({event_type: .[0].event_type, user_id: .[0].user_id, low: (map(.event_id) | min), users: (map(.data.k) | unique | length)})"),
    "jq_reduce": over(docs, "reduce (., inputs) as $r (0; . + $r.n_chars)"),
    "jq_unique": over(docs, "[., inputs] | map({lang, source}) | unique"),
    "jq_unique_by": over(docs, "[., inputs] | unique_by(.source) | map({doc_id, source, n_chars})", "n_chars", "doc_id"),
    "jq_group_first": over(docs, "[., inputs] | group_by(.lang) | map({lang: .[0].lang, source: .[0].source, n: length})", "n_chars", "doc_id"),
    "jq_sort_by": over(docs, "[., inputs] | sort_by([.n_chars, .doc_id]) | .[10:30] | map({doc_id, n_chars})"),
    "jq_limit": over(docs, "[., inputs] | sort_by(.doc_id) | .[0:7] | map({doc_id})"),
    "jq_length": over(docs, '[., inputs] | map(select(.lang == "de")) | length'),
    "jq_strings": over(docs, '{doc_id, up: (.lang | ascii_upcase), cut: (.source | ltrimstr("src")), long: (.lang | length), has: (.source | test("[0-4]$"))}'),
    "jq_array_ends": over(orders, '{id, n: (.orders | length), first: .orders[0].key, last: .orders[-1].key, keys: (.orders | map(.key) | add)}'),
    "jq_try": over(events, "{id: .event_id, q: (.user_id / .data.k)?}"),
    **{f.__name__: f for f in (jq_mixed_sort, jq_mixed_group, jq_mixed_compare, jq_join, jq_in_stream, jq_foreach_stream, jq_range, jq_limit_items, jq_def_arguments, jq_def, jq_index_join, jq_in_semi, jq_foreach_running, jq_cross, jq_transpose, jq_entries, jq_with_entries, jq_array_setops, jq_catch, jq_break, jq_leaf_paths, jq_fallback)},
}
#: The field of several types as what it is compared by: rank, number, text, and for arrays and objects their parts.
MIXED = """m AS (SELECT doc_id, doc_id % 7 AS t, n_chars AS c, lang FROM documents), k AS (SELECT doc_id, CASE t WHEN 0 THEN 0 WHEN 1 THEN CASE WHEN c % 2 = 0 THEN 2 ELSE 1 END WHEN 2 THEN 3 WHEN 3 THEN 4 WHEN 4 THEN 5 WHEN 5 THEN 6 ELSE 3 END AS rank,
CAST(CASE t WHEN 2 THEN c WHEN 6 THEN c % 5 + 0.5 WHEN 4 THEN c % 3 ELSE 0 END AS DOUBLE) AS number, CASE WHEN t IN (3, 4, 5) THEN lang ELSE '' END AS text, CASE t WHEN 5 THEN c % 3 ELSE 0 END AS last FROM m)"""
K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
SQL = {
    "jq_mixed_sort": f"WITH {MIXED} SELECT doc_id, row_number() OVER (ORDER BY rank, number, text, last, doc_id) AS place FROM k",
    "jq_mixed_group": f"WITH {MIXED} SELECT count(*) AS n, min(doc_id) AS first FROM k GROUP BY rank, number, text, last",
    "jq_mixed_compare": f"WITH {MIXED} SELECT doc_id FROM k WHERE rank = 3 AND number > 2 OR rank = 4 AND text <= 'fr' OR rank = 2 OR rank = 6 AND last = 1",
    "jq_join": "SELECT o_orderkey AS key, o_orderstatus AS status, c_name AS customer FROM orders LEFT JOIN customer ON c_custkey = o_custkey",
    "jq_in_stream": "SELECT doc_id, lang FROM documents WHERE lang IN (SELECT lang FROM documents WHERE n_chars > 10000) AND source NOT IN (SELECT source FROM documents WHERE n_chars < 20)",
    "jq_foreach_stream": "SELECT event_id, CAST(sum(user_id) OVER (ORDER BY event_id) AS BIGINT) AS running FROM events",
    "jq_range": "SELECT n_name AS name, i FROM nation, unnest(range(CAST(n_nationkey AS BIGINT))) AS t(i) WHERE i % 2 = 0",
    "jq_limit_items": "SELECT o_custkey AS id, o_orderkey AS key FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 2",
    "jq_def_arguments": "SELECT o_custkey AS id, CAST(coalesce(sum(o_orderkey) FILTER (WHERE o_orderstatus = 'O'), 0) AS BIGINT) AS open, CAST(coalesce(sum(o_orderkey) FILTER (WHERE o_orderstatus = 'F'), 0) AS BIGINT) AS done, 2 * count(*) AS more FROM orders GROUP BY 1",
    "jq_break": "SELECT id, key, s = 'O' AS \"in\", s = 'P' AS has FROM (SELECT o_custkey AS id, min(o_orderkey) AS key, arg_min(o_orderstatus, o_orderkey) AS s FROM orders WHERE o_orderkey > 100 GROUP BY 1)",
    "jq_catch": "SELECT CASE WHEN doc_id % 3 = 0 THEN -1 ELSE doc_id END AS doc_id, CASE WHEN doc_id % 3 = 0 THEN 'third' ELSE 'fine' END AS said FROM documents",
    "jq_with_entries": "SELECT CAST(n_nationkey AS BIGINT) AS key, 'name,nationkey,regionkey' AS names, CAST(n_regionkey AS VARCHAR) AS up FROM nation",
    "jq_transpose": "SELECT CAST(n_nationkey AS BIGINT) AS a, n_name AS b, CAST(NULL AS VARCHAR) AS c, CAST(n_regionkey AS BIGINT) AS d FROM nation",
    "jq_array_setops": "SELECT o_custkey AS id, count(*) + 2 AS more, count(*) - 1 AS less, CAST(0 AS BIGINT) AS open FROM orders GROUP BY 1",
    "jq_path": f"SELECT event_id AS id, {K} AS k FROM events",
    "jq_object": "SELECT source || ':' || doc_id AS ref, lang, n_chars / 2 AS half FROM documents",
    "jq_select": "SELECT doc_id FROM documents WHERE lang = 'en' AND (n_chars > 1000 OR source != 'src1') AND doc_id % 2 != 0",
    "jq_comma": "SELECT lang AS value FROM documents UNION ALL SELECT source FROM documents",
    "jq_explode": "SELECT o_orderkey AS key, o_orderstatus AS status FROM orders WHERE o_orderstatus != 'F'",
    "jq_binding": "SELECT o_custkey AS id, o_orderkey AS key FROM orders WHERE o_orderstatus = 'P'",
    "jq_any": "SELECT o_custkey AS id FROM orders GROUP BY 1 HAVING bool_or(o_orderstatus = 'P') AND bool_and(o_orderkey > 100)",
    "jq_if": "SELECT doc_id, CASE WHEN n_chars < 500 THEN 'small' WHEN n_chars < 2000 THEN 'middle' ELSE 'large' END AS size FROM documents",
    "jq_alternative": f"SELECT event_id AS id, coalesce({K}, 0) AS k, 'none' AS missing FROM events",
    "jq_has": "SELECT doc_id FROM documents WHERE source LIKE 'src1%'",
    "jq_del": "SELECT doc_id + 1 AS doc_id, upper(lang) AS lang FROM documents",
    "jq_group_by": "SELECT lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars, max(n_chars) AS most FROM documents GROUP BY 1",
    "jq_aggs": f"SELECT event_type, user_id, min(event_id) AS low, count(DISTINCT {K}) + CASE WHEN count(*) > count({K}) THEN 1 ELSE 0 END AS users FROM events GROUP BY 1, 2",
    "jq_reduce": "SELECT CAST(sum(n_chars) AS BIGINT) AS value FROM documents",
    "jq_unique": "SELECT DISTINCT lang, source FROM documents",
    "jq_unique_by": "SELECT doc_id, source, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) = 1",
    "jq_group_first": "SELECT lang, arg_min(source, (n_chars, doc_id)) AS source, count(*) AS n FROM documents GROUP BY lang",
    "jq_sort_by": "SELECT doc_id, n_chars FROM documents ORDER BY n_chars, doc_id LIMIT 20 OFFSET 10",
    "jq_limit": "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 7",
    "jq_length": "SELECT count(*) AS value FROM documents WHERE lang = 'de'",
    "jq_strings": "SELECT doc_id, upper(lang) AS up, substring(source, 4) AS cut, CAST(length(lang) AS BIGINT) AS long, regexp_matches(source, '[0-4]$') AS has FROM documents",
    "jq_array_ends": "SELECT o_custkey AS id, count(*) AS n, min(o_orderkey) AS first, max(o_orderkey) AS last, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders GROUP BY 1",
    "jq_try": f"SELECT event_id AS id, CASE WHEN {K} != 0 THEN user_id / {K} END AS q FROM events",
    "jq_def": "SELECT doc_id, n_chars * 2 AS twice FROM documents",
    "jq_index_join": "SELECT CAST(n_nationkey AS BIGINT) AS id, r_name AS name FROM nation JOIN region ON r_regionkey = n_regionkey",
    "jq_in_semi": "SELECT doc_id FROM documents WHERE lang IN ('en', 'de') AND source IN ('src1', 'src2', 'src3')",
    "jq_foreach_running": "SELECT o_custkey AS id, o_orderkey AS key, CAST(sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS running FROM orders",
    "jq_cross": "SELECT r_name, n FROM region, (SELECT unnest([1::BIGINT, 2::BIGINT, 3::BIGINT]) AS n)",
    "jq_entries": f"SELECT event_id, 'k' AS key, {K} AS value FROM events WHERE props IS NOT NULL",
    "jq_leaf_paths": "SELECT o_custkey AS id, 1 + 2 * count(*) AS n FROM orders GROUP BY 1",
    "jq_fallback": "SELECT o_custkey AS id, CAST(coalesce(sum(o_orderkey) FILTER (WHERE o_orderstatus = 'F'), 0) AS BIGINT) AS f, CAST(coalesce(sum(o_orderkey) FILTER (WHERE o_orderstatus = 'O'), 0) AS BIGINT) AS o, 'c' || o_custkey AS label FROM orders GROUP BY 1",
}
