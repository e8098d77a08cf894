"""Registered queries over sources, sinks and small expressions: what is written and read back
equals what a plain SQL query says about the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import canonical_names, iso_text, parse_iso, utc_text
from ..operators import cleaning, features, labels, retrieval, scoring
from ..operators import models as model_ops
from ..session import scratch_path
from ..settings import POUTCOME_LABELS, contacts_settings
from ..sources import files
from ..sources import logs as log_tables
from ..sources.logs import PROBABILITY_SQL
from ..sources.tables import contacts, read_table
from .catalog import (CHUNKS_CTE, CLEAN_CTE, LOG_CTE, SEED, SPLIT_CTE, WITH_CONTACTS, _bucket_sql, _encoder_sql, _fit, _plog,
                      _values, clean_contacts, encoder_for, query, split_contacts)


@query("split_files", f"{SPLIT_CTE} SELECT contact_id, y FROM split WHERE split = 'test'")
def q_split_files(spark, sf):
    """One folder per split, one split read back."""
    path = scratch_path(spark, "splits")
    files.write_splits(split_contacts(spark, sf, history=False).select("contact_id", "y", "split"), path)
    return files.read_split(spark, path, "test")


@query("encoder_file", f"WITH e AS ({_encoder_sql()}) SELECT contact_id, num__total_price, ord__priority, \"ohe__region_ASIA\" FROM e WHERE split = 'test'")
def q_encoder_file(spark, sf):
    """The encoder saved, loaded and applied."""
    split = split_contacts(spark, sf)
    path = scratch_path(spark, "encoder")
    files.save_encoder(spark, encoder_for(split.where(F.col("split") == "train")), path)
    out = files.load_encoder(spark, path).transform(split.where(F.col("split") == "test"), keep=["contact_id"])
    return out.select("contact_id", F.round("num__total_price", 6).alias("num__total_price"), "ord__priority", "ohe__region_ASIA")


@query("scorer_files", f"{SPLIT_CTE} SELECT contact_id, true AS same, 'LogisticRegression' AS card_name FROM split WHERE split = 'test'")
def q_scorer_files(spark, sf):
    """A saved model, encoder and card score like the ones in memory."""
    enc, r = _fit(spark, sf, "LogisticRegression")
    path = scratch_path(spark, "scorer")
    files.save_scorer(spark, path, r["model"], enc, model_ops.model_card(r))
    model, encoder, card = files.load_scorer(spark, path)
    test = split_contacts(spark, sf).where(F.col("split") == "test")
    a = scoring.score_rows(test, enc, r["model"], r["threshold"], id_cols=["contact_id"])
    b = scoring.score_rows(test, encoder, model, card["tuned_threshold"], id_cols=["contact_id"])
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in a.columns]
    both = a.alias("a").join(b.alias("b"), F.col("a.contact_id") == F.col("b.contact_id"))
    return both.select("a.contact_id", F.forall(F.array(*same), lambda x: x).alias("same"), F.lit(card["model_name"]).alias("card_name"))


@query("pipeline_artifact", f"{SPLIT_CTE} SELECT contact_id, true AS same FROM split WHERE split = 'test'")
def q_pipeline_artifact(spark, sf):
    """Encoder and model saved and loaded as one pipeline score raw contacts alike."""
    from pyspark.ml.functions import vector_to_array

    enc, r = _fit(spark, sf, "LogisticRegression")
    path = scratch_path(spark, "pipeline")
    files.save_pipeline(path, enc, r["model"])
    test = split_contacts(spark, sf).where(F.col("split") == "test")
    p = F.round(vector_to_array("probability")[1], 9)
    given = r["model"].transform(model_ops.assemble(enc.transform(test, keep=["contact_id", "y"]), enc.feature_names(), "y"))
    loaded = files.load_pipeline(spark, path).transform(test)
    both = given.select("contact_id", p.alias("a")).join(loaded.select("contact_id", p.alias("b")), "contact_id")
    return both.select("contact_id", (F.col("a") == F.col("b")).alias("same"))


_MIXED = """CASE event_id % 5 WHEN 0 THEN 'not json' WHEN 1 THEN '{"other": true}' WHEN 2 THEN '{"output": {"p": "high"}}'
  WHEN 3 THEN concat('{"output": {"p": ', CAST(event_id % 100 AS STRING), ', "tags": [7, ', CAST(event_id AS STRING), ']}}')
  ELSE concat('{"output": {"p": ', CAST(event_id % 50 AS STRING), '}, "input": ', props, '}') END"""


@query("dynamic_log", """SELECT event_id,
  CAST(CASE event_id % 5 WHEN 3 THEN event_id % 100 WHEN 4 THEN event_id % 50 ELSE -1 END AS INTEGER) AS p,
  CAST(CASE WHEN event_id % 5 = 3 THEN event_id ELSE -1 END AS BIGINT) AS tag,
  CAST(CASE WHEN event_id % 5 = 4 THEN CAST(json_extract_string(props, '$.k') AS INTEGER) ELSE -1 END AS INTEGER) AS k,
  event_id % 5 <> 0 AS is_json, strftime(ts, '%Y-%m-%d %H:%M:%S UTC') AS logged_at
FROM events""")
def q_dynamic_log(spark, sf):
    """Records of five shapes in one VARIANT column, written, read back and taken apart."""
    ev = read_table(spark, sf, "events").withColumn("record", F.expr(_MIXED))
    path = scratch_path(spark, "dynamic-log")
    both = ev.withColumn("id_text", F.col("event_id").cast("string"))
    log_tables.append_prediction_log(log_tables.variant_records(both, ["record", "id_text"], "ts"), path)
    log = log_tables.read_log(spark, path)
    field = log_tables.log_field
    return log.select(field("id_text", "$", "bigint").alias("event_id"), field("record", "$.output.p", "int", -1).alias("p"),
                      field("record", "$.output.tags[1]", "bigint", -1).alias("tag"), field("record", "$.input.k", "int", -1).alias("k"),
                      F.col("record").isNotNull().alias("is_json"), "logged_at")


@query("dynamic_log_summary", """SELECT count(*) AS records, count(p) AS scored, CAST(sum(CASE WHEN p >= 25 THEN 1 ELSE 0 END) AS BIGINT) AS positive,
  coalesce(round(avg(p), 6), 0.0) AS mean_probability
FROM (SELECT CAST(CASE event_id % 5 WHEN 3 THEN event_id % 100 WHEN 4 THEN event_id % 50 END AS DOUBLE) AS p FROM events)""")
def q_dynamic_log_summary(spark, sf):
    """Totals over records of which some lack the field or hold another type there."""
    ev = read_table(spark, sf, "events").withColumn("record", F.expr(_MIXED))
    return log_tables.variant_summary(log_tables.variant_records(ev, ["record"], "ts"), "record", "$.output.p", 25.0)


_RUN_KEYS = [("metric", f"{s}_{m}") for s in ("val", "test") for m in ("accuracy", "f1", "pr_auc", "precision", "recall", "roc_auc")]
_RUN_KEYS += [("metric", "tuned_threshold"), ("param", "C"), ("param", "class_weight"), ("param", "max_iter"), ("param", "solver")]


@query("run_log", "SELECT * FROM (VALUES " + ", ".join(f"('LogisticRegression', '{k}', '{n}', true)" for k, n in _RUN_KEYS) + ") v(model, kind, key, has_value)")
def q_run_log(spark, sf):
    """Parameters and metrics of a run, appended and read back."""
    _, r = _fit(spark, sf, "LogisticRegression")
    path = scratch_path(spark, "runs")
    model_ops.log_run(spark, r, path)
    return spark.read.parquet(path).select("model", "kind", "key", (F.length("value") > 0).alias("has_value"))


@query("customers_json", "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer")
def q_customers_json(spark, sf):
    """Requests as JSON arrays of up to 50 customers, and every tenth as a single object."""
    c = read_table(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_mktsegment", "c_acctbal")
    one = F.struct(*c.columns)
    alone = c.where("c_custkey % 10 = 0").select(F.to_json(one).alias("j"))
    many = c.where("c_custkey % 10 <> 0").groupBy(F.floor(F.col("c_custkey") / 50)).agg(F.to_json(F.collect_list(one)).alias("j")).select("j")
    return files.customers_of_json(alone.unionByName(many), "j", T.StructType(c.schema.fields))


@query("prediction_log_append", f"""{LOG_CTE}
SELECT event_id, probability, strftime(ts, '%Y-%m-%d %H:%M:%S UTC') AS logged_at FROM plog""")
def q_log_append(spark, sf):
    """The log appended in two batches."""
    path = scratch_path(spark, "prediction-log")
    rec = log_tables.log_records(_plog(spark, sf), ["probability"], ["event_id"], "ts")
    for half in (0, 1):
        log_tables.append_prediction_log(rec.where(F.col("input.event_id") % 2 == half), path)
    return log_tables.read_log(spark, path).select("input.event_id", "output.probability", "logged_at")


@query("stream_log_append", f"SELECT event_id, {PROBABILITY_SQL} AS probability FROM events")
def q_stream_append(spark, sf):
    """The log appended by a stream."""
    from ..streaming.scoring import append_prediction_log, file_stream, run_to_completion

    base = scratch_path(spark, "log-stream")
    src = file_stream(spark, f"{sf}/events.parquet").select(
        "event_id", (F.get_json_object("props", "$.k").cast("int").cast("double") / F.lit(100.0)).alias("probability"))
    run_to_completion(append_prediction_log(src, f"{base}/sink", f"{base}/ckpt"))
    return spark.read.parquet(f"{base}/sink")


@query("research_log_append", """
SELECT text AS query, length(text) AS answer_length, strftime(make_timestamp(conv_id * 1000000), '%Y-%m-%d %H:%M:%S UTC') AS logged_at
FROM conversations WHERE role = 'user'""")
def q_research(spark, sf):
    """Questions and answers, appended and read back (the id stands for the time)."""
    asked = read_table(spark, sf, "conversations").where(F.col("role") == "user").select(
        "text", F.reverse("text").alias("answer"), F.timestamp_seconds("conv_id").alias("at"))
    path = scratch_path(spark, "research-log")
    log_tables.append_research_log(log_tables.research_records(asked, "text", "answer", "at"), path)
    back = log_tables.read_log(spark, path)
    return back.select("query", F.length("answer").cast("long").alias("answer_length"), "logged_at")


@query("document_files", "SELECT lang, CAST(sum(length(text)) + count(*) AS BIGINT) AS n_chars FROM documents GROUP BY lang")
def q_document_files(spark, sf):
    """Texts written as files in a folder per language and scanned as whole files."""
    path = scratch_path(spark, "document-files")
    read_table(spark, sf, "documents").select("lang", "text").write.partitionBy("lang").text(path)
    found = retrieval.read_documents(spark, f"{path}/*")
    return found.groupBy(F.regexp_extract("path", "lang=([^/]+)/", 1).alias("lang")).agg(F.sum(F.length("text")).alias("n_chars"))


@query("index_file", f"""{CHUNKS_CTE},
cb AS (SELECT doc_id, chunk_id, b, count(*) AS n FROM ({_bucket_sql('text').replace('__src', 'chunks')}) GROUP BY ALL)
SELECT doc_id, chunk_id, CAST(count(*) AS INTEGER) AS buckets, CAST(sum(n) AS DOUBLE) AS tokens FROM cb GROUP BY ALL""")
def q_index_file(spark, sf):
    """An index built, written and loaded."""
    path = scratch_path(spark, "index")
    retrieval.build_index(read_table(spark, sf, "documents"), path, 512, 64, 256, "md5")
    idx = retrieval.read_index(spark, path)
    counts = F.filter("embedding", lambda v: v != 0)
    return idx.select("doc_id", "chunk_id", F.size(counts).alias("buckets"),
                      F.aggregate(counts, F.lit(0.0), lambda s, v: s + v.cast("double")).alias("tokens")).where("buckets > 0")


@query("leakage_dropped", f"{WITH_CONTACTS} SELECT contact_id, y, false AS has_duration FROM contacts")
def q_leakage(spark, sf):
    """A leaking column is dropped where it is present."""
    df = contacts(spark, sf, history=False).withColumn("duration", F.col("total_price"))
    out = cleaning.drop_leakage(df, contacts_settings().drop_cols)
    return out.select("contact_id", "y", F.lit("duration" in out.columns).alias("has_duration"))


@query("canonical_names", "SELECT o_orderkey, o_totalprice AS cons_price_idx, true AS dotted_again FROM orders")
def q_canonical(spark, sf):
    """P10: dotted names to underscores and back."""
    o = read_table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("cons.price.idx"))
    under = canonical_names(o)
    back = canonical_names(under, "dotted")
    return under.withColumn("dotted_again", F.lit(back.columns == o.columns))


@query("time_texts", f"""SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S UTC') AS utc, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS iso,
true AS parsed_back, true AS zulu_parsed FROM events""")
def q_times(spark, sf):
    """Times as text and back, naive and with a zone."""
    e = read_table(spark, sf, "events")
    return e.select("event_id", utc_text("ts").alias("utc"), iso_text("ts").alias("iso"),
                    (parse_iso(iso_text("ts")) == F.col("ts")).alias("parsed_back"),
                    (parse_iso(F.concat(iso_text("ts"), F.lit("Z"))) == F.col("ts")).alias("zulu_parsed"))


@query("poutcome_labels", f"""{WITH_CONTACTS}
SELECT contact_id, coalesce(m.label, poutcome) AS poutcome_label FROM contacts
LEFT JOIN (VALUES {_values(POUTCOME_LABELS)}) m(code, label) ON poutcome = m.code""")
def q_poutcome(spark, sf):
    """Display labels of the previous outcome."""
    return labels.with_labels(contacts(spark, sf), {"poutcome": POUTCOME_LABELS}).select("contact_id", "poutcome_label")


@query("positive_weights", f"{CLEAN_CTE} SELECT contact_id, CASE WHEN y = 1 THEN 8.0 ELSE 1.0 END::DOUBLE AS weight FROM clean")
def q_positive(spark, sf):
    """a fixed weight for the positive class."""
    return clean_contacts(spark, sf, history=False).select("contact_id", features.positive_weight("y", 8.0).alias("weight"))


@query("form_defaults", f"""{WITH_CONTACTS}
SELECT contact_id, CASE WHEN contact_id % 3 = 0 THEN 'EUROPE' ELSE region END AS region, 'cellular' AS contact FROM contacts""")
def q_defaults(spark, sf):
    """Q5: missing values and missing columns are filled."""
    df = contacts(spark, sf, history=False).select("contact_id", F.when(F.col("contact_id") % 3 != 0, F.col("region")).alias("region"))
    return scoring.with_defaults(df, {"region": "EUROPE", "contact": "cellular"})


@query("built_features", f"""{SPLIT_CTE},
n AS (SELECT split, y, count(*) AS n FROM split GROUP BY split, y)
SELECT split, y, CASE WHEN split = 'train' THEN max(n) OVER (PARTITION BY split) ELSE n END AS n FROM n""")
def q_built(spark, sf):
    """clean, split, encode, balance and write; rows per split and class of the written table."""
    path = scratch_path(spark, "features")
    settings = contacts_settings().with_(seed=SEED)
    features.build_features(contacts(spark, sf), settings, "contact_id", path)
    return spark.read.parquet(path).groupBy("split", "y").agg(F.count("*").alias("n"))

