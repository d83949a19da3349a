"""Queries: readers and sinks, fed with text and listings derived from the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from demur.functions.conditions import enumerate_conditions, parse_spec, tag
from demur.operators.curves import with_perfect, curve
from demur.operators.ranking import running
from demur.sources.facts import as_json, complete_cache, export_text, merge_keys, read_fact
from demur.sources.features import assemble, pool_tokens, require_all, with_fallback
from demur.sources.images import read_images, write_png
from demur.sources.listing import available_ids, reconcile, roll_up
from demur.sources.records import clean_lookup, id_seconds, last_wins, parse_records, plausible, read_ids, usable
from demur.sources.staging import shared_folder

from .registry import query, u, with_ctes
from .views import GATES, entities, fact, items, table, test_long


def record_lines(spark, sf):
    """One ragged line per order line: names hold commas, some second parts are short, some measures bad."""
    li = table(spark, sf, "lineitem").join(
        table(spark, sf, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    number = lambda c: F.col(c).cast("string")
    cal = F.when((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 1), F.lit("n/a")).otherwise(number("l_extendedprice"))
    second = F.when(F.col("l_quantity") > 25, F.lit("ingr_0,short")).otherwise(
        F.concat_ws(",", F.lit("ingr_1"), F.lit("salt"), number("l_tax"), number("l_discount"), F.lit("0"), F.lit("0"), F.lit("0")))
    return li.select(F.concat_ws(
        ",", F.concat(F.lit("dish_"), F.col("l_orderkey"), F.lit("-"), F.col("l_suppkey")), cal, number("l_quantity"),
        number("l_discount"), number("l_tax"), number("l_linenumber"), F.concat(F.lit("ingr_"), F.col("l_partkey")),
        F.replace("p_name", F.lit(" "), F.lit(",")), number("l_quantity"), number("l_extendedprice"), F.lit("1"), F.lit("2"),
        F.lit("3"), second).alias("value"))


@query("ragged_parse", """SELECT 'dish_' || l_orderkey || '-' || l_suppkey AS id, l_extendedprice AS cal, l_quantity AS mass,
    CASE WHEN l_quantity > 25 THEN 1 ELSE 2 END AS n_parts, p_name AS first_name, l_quantity AS first_grams,
    l_extendedprice AS first_amount, CASE WHEN l_quantity > 25 THEN 0.0 ELSE l_tax END AS second_grams
  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE NOT (l_returnflag = 'R' AND l_linenumber = 1)""")
def ragged_parse(spark, sf):
    rec = parse_records(record_lines(spark, sf))
    return rec.select("id", "cal", "mass", F.size("parts").alias("n_parts"), F.col("parts")[0]["name"].alias("first_name"),
                      F.col("parts")[0]["grams"].alias("first_grams"), F.col("parts")[0]["amount"].alias("first_amount"),
                      F.coalesce(F.try_element_at("parts", F.lit(2))["grams"], F.lit(0.0)).alias("second_grams"))


@query("last_wins_union", """SELECT o_orderkey AS id, CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice*2 ELSE o_totalprice END AS price,
    CASE WHEN o_orderpriority = '1-URGENT' THEN 'second' ELSE 'first' END AS origin FROM orders""")
def last_wins_union(spark, sf):
    """Two files with repeated ids; the later file wins."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"), "o_orderpriority")
    first = o.select("id", "price", F.lit("first").alias("origin"))
    second = o.filter("o_orderpriority = '1-URGENT'").select("id", (F.col("price") * 2).alias("price"), F.lit("second").alias("origin"))
    return last_wins([first, second], "id")


@query("dim_lookup_clean", """SELECT p_name AS name, arg_max(p_retailprice, p_partkey) AS cal_g, arg_max(p_size, p_partkey)::DOUBLE AS fat_g
  FROM part WHERE p_type <> 'SMALL' GROUP BY p_name""")
def dim_lookup_clean(spark, sf):
    """Text columns with padded names and bad numbers."""
    raw = table(spark, sf, "part").select(
        F.concat(F.lit("  "), "p_name", F.lit(" ")).alias("name"), "p_partkey", F.col("p_retailprice").cast("string").alias("cal_g"),
        F.when(F.col("p_type") == "SMALL", "n/a").otherwise(F.col("p_size").cast("string")).alias("fat_g"))
    return clean_lookup(raw, "name", ["cal_g", "fat_g"], "p_partkey")


@query("usable_split", with_ctes("""SELECT id FROM items WHERE role = 'test' AND mass > 0 AND mass < 200 AND truth >= 0 AND truth < 400000
  AND id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')""", "items"))
def usable_split(spark, sf):
    ids = entities(spark, sf).filter("role = 'test'").select("id")
    good = items(spark, sf).filter(plausible(F.col("mass"), F.col("truth"), 200, 400000))
    there = table(spark, sf, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("id"))
    return usable(ids, good, there)


@query("availability", """SELECT DISTINCT user_id AS id FROM events WHERE event_type = 'error' AND (props::JSON->>'k') IS NOT NULL""")
def availability(spark, sf):
    """Ids that have a file, from a JSON manifest of file sizes."""
    ev = table(spark, sf, "events").select(F.col("user_id").alias("id"), F.from_json(
        F.concat(F.lit('{"'), "event_type", F.lit('": '), F.get_json_object("props", "$.k"), F.lit("}")),
        "map<string,bigint>").alias("files"))
    manifest = ev.select("id", F.explode("files").alias("file", "size"))
    return available_ids(manifest, "error")


@query("listing_rollup", """WITH p AS (SELECT string_split(url, '/') AS p, length(html) AS size FROM pages)
  SELECT p[3] AS id, p[5] AS file, max(size) AS size FROM p WHERE len(p) >= 5 GROUP BY 1, 2""")
def listing_rollup(spark, sf):
    objects = table(spark, sf, "pages").select(F.col("url").alias("name"), F.length("html").cast("bigint").alias("size"))
    return roll_up(objects, id_part=3, file_part=5)


@query("reconcile_status", """SELECT status, count(*) AS n, sum(expected)::BIGINT AS expected_bytes FROM
    (SELECT e.expected, CASE WHEN p.doc_id IS NULL THEN 'fetch' WHEN e.doc_id IS NULL THEN 'extra'
       WHEN e.expected = 0 OR e.expected = p.present THEN 'skip' ELSE 'FAIL' END AS status FROM
       (SELECT doc_id, n_chars AS expected FROM documents) e FULL JOIN
       (SELECT doc_id, CASE WHEN toxic = 1 THEN length(text) - 1 ELSE length(text) END AS present FROM documents JOIN labels USING (doc_id)) p
       USING (doc_id)) GROUP BY status""")
def reconcile_status(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "n_chars", F.length("text").cast("bigint").alias("len"))
    lab = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), "toxic")
    present = docs.join(lab, "id").select("id", F.when(F.col("toxic") == 1, F.col("len") - 1).otherwise(F.col("len")).alias("size"))
    got = reconcile(docs.select("id", F.col("n_chars").alias("size")), present)
    return got.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("expected").alias("expected_bytes"))


@query("feature_fallback", f"""SELECT vec_id AS id, CASE WHEN {u("'calib-cache'", 'vec_id')} < 0.4 THEN 'calib' ELSE 'train' END AS source,
    round(CASE WHEN {u("'calib-cache'", 'vec_id')} < 0.4 THEN 2 ELSE 1 END * list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings""")
def feature_fallback(spark, sf):
    """Calibration ids read their own split where it is cached, else the train split."""
    from demur.functions.draws import uniform
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("features"))
    train = e.withColumn("split", F.lit("train"))
    calib = e.filter(uniform("calib-cache", F.col("id")) < 0.4).select(
        "id", F.transform("features", lambda x: x * 2).alias("features"), F.lit("calib").alias("split"))
    got = with_fallback(e.select("id"), train.unionByName(calib), "calib")
    return got.select("id", "source", F.round(F.aggregate("features", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("token_pool", """WITH t AS (SELECT vec_id, (i - 1)//8 AS token, (i - 1)%8 AS dim, v::DOUBLE AS v FROM
    (SELECT vec_id, unnest(embedding) AS v, unnest(range(1, 65)) AS i FROM embeddings))
  SELECT vec_id AS id, dim, round(max(v) FILTER (WHERE token = 0), 6) AS first, round(avg(v) FILTER (WHERE token > 0), 6) AS mean,
    round(stddev_samp(v) FILTER (WHERE token > 0), 6) AS sd FROM t GROUP BY vec_id, dim""")
def token_pool(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.posexplode("embedding").alias("i", "v"))
    tokens = e.select("id", F.floor(F.col("i") / 8).alias("token"), (F.col("i") % 8).alias("dim"), F.col("v").cast("double").alias("v"))
    return pool_tokens(tokens).select("id", "dim", *[F.round(c, 6).alias(c) for c in ("first", "mean", "sd")])


_LADDER = {"click": [0.0, 1.0, 2.0], "purchase": [0.0, 5.0, 9.0], "error": [1.0, 0.85, 0.7], "signup": [0.0, 0.1, 0.2]}
_BOTH = {"view": [("click", 2.0), ("purchase", 7.0)]}


@query("spec_parse", """WITH e AS (SELECT event_id, event_type AS t, (props::JSON->>'k')::INT AS k FROM events)
  SELECT event_id, CASE WHEN t = 'error' THEN 'error' WHEN t = 'signup' THEN 'signup' || k || 'p5' WHEN t = 'view' THEN 'view'
      WHEN t = 'click' THEN 'clean' ELSE 'purchase' || k || '+error' END AS tag,
    CASE WHEN t = 'click' THEN 0 WHEN t IN ('purchase', 'view') THEN 2 ELSE 1 END AS n_steps,
    CASE WHEN t = 'click' THEN '' WHEN t = 'view' THEN 'click,purchase' WHEN t = 'purchase' THEN 'purchase,error' ELSE t END AS families,
    round(CASE WHEN t = 'click' THEN 0 WHEN t = 'view' THEN 9 WHEN t = 'purchase' THEN k + 0.85 WHEN t = 'error' THEN 0.85
      ELSE k + 0.5 END, 4)::DOUBLE AS total FROM e""")
def spec_parse(spark, sf):
    """Specs with defaults, compounds and several parts, written from the events."""
    k = F.get_json_object("props", "$.k")
    spec = (F.when(F.col("event_type") == "click", F.lit("clean")).when(F.col("event_type") == "purchase", F.concat(
        F.lit("purchase:"), k, F.lit("+error"))).when(F.col("event_type") == "signup", F.concat(F.lit("signup:"), k, F.lit(".5")))
        .otherwise(F.col("event_type")))
    e = table(spark, sf, "events").select("event_id", spec.alias("spec"))
    e = e.withColumn("steps", parse_spec(F.col("spec"), _LADDER, _BOTH))
    return e.select("event_id", tag(F.col("spec")).alias("tag"), F.size("steps").alias("n_steps"),
                    F.array_join(F.col("steps.family"), ",").alias("families"),
                    F.round(F.aggregate("steps.severity", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("condition_dim", """WITH s AS (SELECT event_type AS family, k, row_number() OVER (PARTITION BY event_type ORDER BY k) AS step FROM
    (SELECT DISTINCT event_type, (props::JSON->>'k')::INT AS k FROM events))
  SELECT family || ':' || k AS spec FROM s WHERE step > 1 UNION ALL SELECT unnest(['clean', 'screenshot', 'phone'])""")
def condition_dim(spark, sf):
    """Conditions enumerated from ladders; here a ladder is the distinct severities of an event type."""
    ladders = table(spark, sf, "events").select("event_type", F.get_json_object("props", "$.k").cast("int").alias("k")).groupBy(
        F.col("event_type").alias("family")).agg(F.sort_array(F.collect_set("k")).alias("severities"))
    return enumerate_conditions(ladders)


@query("summary_json", with_ctes("SELECT gate, coverage, k, round(risk, 4) AS risk FROM curve WHERE gate <> 'random'", "curve"))
def summary_json(spark, sf):
    """Curves as nested JSON, one text per gate, and read back."""
    curves = curve(with_perfect(test_long(spark, sf), GATES[0]))
    nested = curves.groupBy("gate").agg(F.collect_list(F.struct("coverage", "k", F.round("risk", 4).alias("risk"))).alias("curve"))
    text = as_json(nested, ["gate"])
    back = text.select("gate", F.from_json("summary", "curve array<struct<coverage:double,k:bigint,risk:double>>").alias("s"))
    return back.select("gate", F.inline("s.curve"))


@query("incremental_cache", with_ctes("SELECT id, CASE WHEN role = 'fit' THEN truth ELSE round(truth*2, 2) END AS metric FROM items", "items"))
def incremental_cache(spark, sf):
    it = items(spark, sf)
    cached = it.filter("role = 'fit'").select("id", F.col("truth").alias("metric"))
    return complete_cache(cached, it, lambda todo: todo.select("id", F.round(F.col("truth") * 2, 2).alias("metric")))


@query("summary_merge", with_ctes("""SELECT condition, CASE WHEN condition = 'clean' THEN round(avg(err) FILTER (WHERE role = 'test'), 4)
    ELSE round(avg(err) FILTER (WHERE role = 'fit'), 4) END AS mae FROM fact GROUP BY condition""", "fact"))
def summary_merge(spark, sf):
    mae = lambda role: fact(spark, sf).filter(F.col("role") == role).groupBy("condition").agg(F.round(F.avg("err"), 4).alias("mae"))
    return merge_keys(mae("fit"), mae("test").filter("condition = 'clean'"), ["condition"])


def scratch(spark, name):
    """A new folder for files that a query writes and reads again."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("id_list", """SELECT 'dish_' || o_orderkey AS id, row_number() OVER (ORDER BY o_orderkey) AS place FROM orders""")
def id_list(spark, sf):
    """A list file with padded and blank lines; ids come back in the order of the file."""
    folder = scratch(spark, "ids")
    o = table(spark, sf, "orders").select("o_orderkey")
    lines = o.select("o_orderkey", F.explode(F.array(F.concat(F.lit("  dish_"), F.col("o_orderkey"), F.lit(" ")), F.lit("   "))).alias("value"))
    lines.repartitionByRange("o_orderkey").sortWithinPartitions("o_orderkey").select("value").write.text(folder)
    return running(read_ids(spark, folder), ["position"], rank="place").select("id", "place")


@query("id_time", """SELECT 'dish_' || epoch(o_orderdate)::BIGINT || '_' || o_orderkey AS id, epoch(o_orderdate)::BIGINT AS seconds, year(o_orderdate)::INT AS year FROM orders""")
def id_time(spark, sf):
    """Times out of ids."""
    o = table(spark, sf, "orders")
    seconds = F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).cast("string")
    ids = o.select(F.concat(F.lit("dish_"), seconds, F.lit("_"), F.col("o_orderkey")).alias("id"))
    found = ids.withColumn("seconds", id_seconds(F.col("id")))
    return found.withColumn("year", F.year(F.timestamp_seconds("seconds")))


@query("typed_readback", """SELECT l_orderkey AS id, l_linenumber::BIGINT AS line, l_quantity::DOUBLE AS quantity, l_returnflag AS flag FROM lineitem""")
def typed_readback(spark, sf):
    """A fact exported as text and read back with its types."""
    folder, schema = scratch(spark, "fact"), "id bigint, line bigint, quantity double, flag string"
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").cast("long").alias("line"),
                                             F.col("l_quantity").cast("double").alias("quantity"), F.col("l_returnflag").alias("flag"))
    export_text(li, folder)
    return read_fact(spark, folder, schema).unionByName(read_fact(spark, folder + "-none", schema))


@query("feature_gather", """WITH d AS (SELECT vec_id, (i - 1) % 8 AS dim, (i - 1)//8 AS token, v::DOUBLE AS v FROM
    (SELECT vec_id, unnest(embedding) AS v, unnest(range(1, 65)) AS i FROM embeddings)),
    p AS (SELECT vec_id, dim, max(v) FILTER (WHERE token = 0) AS first, avg(v) FILTER (WHERE token > 0) AS mean, stddev_samp(v) FILTER (WHERE token > 0) AS sd FROM d GROUP BY 1, 2),
    w AS (SELECT vec_id, list_concat(list_concat(list(first ORDER BY dim), list(mean ORDER BY dim)), list(sd ORDER BY dim)) AS f FROM p GROUP BY vec_id)
  SELECT vec_id AS id, label, len(f)::INT AS width, round(list_sum(list_transform(range(24), lambda i: (i + 1)*f[i + 1])), 5) AS weighed FROM w JOIN embeddings USING (vec_id)""")
def feature_gather(spark, sf):
    """Pooled features gathered for labelled ids, every one of which must be there."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label", F.posexplode("embedding").alias("i", "v"))
    tokens = e.select("id", F.floor(F.col("i") / 8).alias("token"), (F.col("i") % 8).alias("dim"), F.col("v").cast("double").alias("v"))
    wanted = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label")
    got = require_all(wanted, assemble(pool_tokens(tokens)))
    weighed = F.aggregate(F.transform("features", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return got.select("id", "label", F.size("features").alias("width"), F.round(weighed, 5).alias("weighed"))


@query("image_files", with_ctes("""SELECT id::VARCHAR AS id, 4 AS height, 16 AS width, 3 AS channels, round(avg(r), 6) AS red, round(avg(g), 6) AS green, round(avg(b), 6) AS blue
  FROM pix GROUP BY id""", "pix"))
def image_files(spark, sf):
    """Pictures written as files, one folder per id, and scanned again: sizes and channel means."""
    from .q_gates import images
    folder = scratch(spark, "images")
    write_png(images(spark, sf).select("id", "height", "width", "data"), folder)
    found = read_images(spark, folder)
    level = lambda c: F.aggregate(F.sequence(F.lit(0), F.col("height") * F.col("width") - 1), F.lit(0.0), lambda a, i: a + F.conv(F.hex(F.substring(
        F.col("data"), i * 3 + c + 1, F.lit(1))), 16, 10).cast("double")) / (F.col("height") * F.col("width"))
    return found.select("id", "height", "width", "channels", *[F.round(level(c), 6).alias(n) for c, n in ((2, "red"), (1, "green"), (0, "blue"))])
