"""Chunk, token, cost and usage queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import tokens as T
from ..operators import chunking as C
from ..operators import usage as U
from ..scratch import staged
from ..streaming import usage as S
from ..tables import table


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def chat(spark, sf_dir):
    return table(spark, sf_dir, "conversations")


MODEL = "element_at(array('gpt-4o', 'gpt-4o-mini', 'claude-3-opus-20240229', 'unlisted'), cast(conv_id % 4 AS INT) + 1)"


def log(spark, sf_dir):
    rows = T.priced(U.logged(chat(spark, sf_dir).withColumn("model", F.expr(MODEL)), F.col("model")))
    return rows.select(
        "request_id", "provider", "model", "input_tokens", "output_tokens", (F.col("output_tokens") * 1.5 + 10).alias("latency_ms"), "total_cost",
        F.when(F.col("request_id") % 9 == 0, "error").otherwise("end_turn").alias("stop_reason"), F.when(F.col("request_id") % 9 == 0, "timeout").alias("error"),
    )


def streamed(spark, sf_dir):
    """Calls and output tokens from a stream over the conversations' files, as
    its SQL has them: no input tokens, errors count. ``streamed_log`` has the
    totals of the log."""
    schema = chat(spark, sf_dir).schema
    # a file source takes folders and patterns
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/conversations.parque[t]")
    calls = stream.filter("role = 'assistant'").select(F.expr(MODEL).alias("model"), F.lit(0).cast("long").alias("input_tokens"), T.estimate(F.col("text")).alias("output_tokens"))
    return S.drained(spark, S.totals(calls), f"usage_{uuid.uuid4().hex}")


def streamed_log(spark, sf_dir):
    """The totals of usage_by_model from a stream over the log, which is
    written first: input tokens come from windows that streams do not have."""
    rows = staged(log(spark, sf_dir), "log")
    stream = spark.readStream.schema(rows.schema).parquet(rows.inputFiles()[0].rsplit("/", 1)[0])
    return S.drained(spark, U.by_model(stream), f"usage_{uuid.uuid4().hex}")


def streamed_events(spark, sf_dir):
    """Windows of the events as a stream over their files."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))
    found = S.drained(spark, S.windowed(stream), f"events_{uuid.uuid4().hex}")
    return found.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", "value")


def streamed_ring(spark, sf_dir):
    """The last 50 requests of the log, as a stream holds them."""
    rows = staged(log(spark, sf_dir).select("request_id", "provider"), "log")
    stream = spark.readStream.schema(rows.schema).parquet(rows.inputFiles()[0].rsplit("/", 1)[0])
    found = S.drained(spark, S.ring(stream, 50), f"ring_{uuid.uuid4().hex}", "update")
    return found.select(F.col("key").alias("provider"), F.explode("request_ids").alias("request_id"))


QUERIES = {
    "chunk_fixed": lambda s, d: C.chunked(docs(s, d)),
    "chunk_fixed_summary": lambda s, d: C.summary(C.chunked(docs(s, d)).withColumn("strategy", F.lit("fixed"))),
    "chunk_sentence": lambda s, d: C.chunked(docs(s, d), "sentence"),
    "chunk_recursive": lambda s, d: C.chunked(docs(s, d), "recursive"),
    "chunk_token": lambda s, d: C.chunked(docs(s, d), "token", 256, 20),
    "chunk_compare": lambda s, d: C.compared(docs(s, d)),
    "token_estimates": lambda s, d: docs(s, d).select("doc_id", T.estimate(F.col("text")).alias("tokens")),
    "message_tokens": lambda s, d: T.conversation_tokens(chat(s, d), "conv_id"),
    "cost_by_call": lambda s, d: T.priced(U.logged(chat(s, d).withColumn("model", F.expr(MODEL)), F.col("model"))).drop("provider"),
    "fits_context": lambda s, d: T.fitting(docs(s, d).withColumn("model", F.expr("element_at(array('gpt-3.5-turbo', 'gpt-4o', 'unlisted'), cast(doc_id % 3 AS INT) + 1)")), "text", 12_000).select("doc_id", "model", "context_window", "fits"),
    "valid_messages": lambda s, d: U.valid_messages(chat(s, d)).select("conv_id", "turn", "role"),
    "mock_replies": lambda s, d: U.valid_messages(chat(s, d)).select("conv_id", "turn", U.mock_reply(F.col("text"), F.col("role"), 40).alias("reply")),
    "token_stream": lambda s, d: U.streamed(chat(s, d).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text"), "id", "text"),
    "usage_summary": lambda s, d: U.summary(log(s, d), 100),
    "usage_by_model": lambda s, d: U.by_model(log(s, d)),
    "usage_recent": lambda s, d: U.recent(log(s, d), 20).select("request_id", "model", "output_tokens", "stop_reason"),
    "usage_capped": lambda s, d: U.retained(log(s, d), 50).select("request_id", "model"),
    "stream_usage_summary": streamed,
    "stream_usage_by_model": streamed_log,
    "stream_event_windows": streamed_events,
    "stream_usage_ring": streamed_ring,
}

_N = "length(text)"
_EST = "CASE WHEN length(text) > 0 THEN greatest(length(text) // 4, 1) ELSE 0 END"
_MODEL = "['gpt-4o', 'gpt-4o-mini', 'claude-3-opus-20240229', 'unlisted'][(conv_id % 4)::INT + 1]"
CHUNKS = """WITH whole AS (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM documents),
starts AS (SELECT doc_id, t, unnest(range(0, length(t), 462)) AS a FROM whole WHERE length(t) > 0),
chunks AS (SELECT doc_id, (a // 462)::INT AS index, substr(t, a + 1, 512) AS text, a::INT AS start_char FROM starts)
"""
#: Pieces of whole texts t: sentences, and what nested separators leave, by depth.
SENTENCES = r"""marked AS (SELECT doc_id, t, regexp_replace(regexp_replace(t, '([.!?])[^\S\n]*\n', '\1' || chr(1) || chr(10), 'g'), '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g') AS m FROM whole),
parts AS (SELECT doc_id, t, list_filter(list_transform(string_split(m, chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS ps FROM marked WHERE t <> '')"""
NESTED = r"""split AS (
  SELECT doc_id, [0]::BIGINT[] AS path, t AS part, 0 AS depth FROM whole WHERE t <> ''
  UNION ALL
  SELECT doc_id, list_append(path, k), list_extract(own, k), depth + 1 FROM (SELECT doc_id, path, depth, own, unnest(range(1, len(own) + 1)) AS k FROM (
    SELECT doc_id, path, depth, list_filter(list_transform(string_split(part, [chr(10) || chr(10), chr(10), '. ', '! ', '? ', ' '][depth + 1]), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS own
    FROM split WHERE length(part) > 512 AND depth < 6))),
cut AS (SELECT doc_id, path, 0 AS a, part FROM split WHERE length(part) <= 512
  UNION ALL SELECT doc_id, path, a, substr(part, a + 1, 512) FROM (SELECT doc_id, path, part, unnest(range(0, length(part), 462)) AS a FROM split WHERE length(part) > 512 AND depth = 6)),
parts AS (SELECT doc_id, t, list(part ORDER BY path, a) AS ps FROM cut JOIN whole USING (doc_id) GROUP BY ALL)"""
#: Chunks of pieces ps: one that begins with piece i and holds at least piece m
#: ends before piece e; ends holds what lies before each piece, with spaces.
GATHERED = """sized AS (SELECT *, len(ps) AS n, list_transform(range(0, len(ps) + 1), lambda k: coalesce(list_sum(list_transform(ps[:k], lambda x: length(x) + 1)), 0)::BIGINT) AS ends FROM parts),
steps AS (
  SELECT doc_id, 0::BIGINT AS index, 0::BIGINT AS i, least(n, greatest(1, len(list_filter(ends, lambda x: x <= 512)) - 1)) AS e FROM sized
  UNION ALL
  SELECT doc_id, index + 1, i, least(n, greatest(e + 1, len(list_filter(ends, lambda x: x - ends[i + 1] <= 512)) - 1))
  FROM (SELECT s.doc_id, s.index, s.e, z.n, z.ends, greatest(s.i, len(list_filter(z.ends, lambda x: z.ends[s.e + 1] - x > 50))) AS i FROM steps s JOIN sized z USING (doc_id) WHERE s.e < z.n)),
chunks AS (SELECT doc_id, index, t, array_to_string(ps[i + 1:e], ' ') AS text FROM steps JOIN sized USING (doc_id))"""
#: Starts of chunks; {back} is how far before the last end a chunk may begin.
PLACED = """{name} AS (
  SELECT doc_id, index, text, greatest(strpos(t, text) - 1, 0) AS start_char, {first} AS next FROM {chunks} WHERE index = 0
  UNION ALL
  SELECT doc_id, index, text, start_char, {next} FROM (
    SELECT c.doc_id, c.index, c.text, w.next, CASE WHEN strpos(substr(c.t, {since} + 1), c.text) = 0 THEN w.next ELSE {since} + strpos(substr(c.t, {since} + 1), c.text) - 1 END AS start_char
    FROM {name} w JOIN {chunks} c ON c.doc_id = w.doc_id AND c.index = w.index + 1))"""
_ONCE = "WITH RECURSIVE whole AS (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM documents)"
_SHOWN = "SELECT doc_id, index::INT AS index, text, start_char::INT AS start_char, (start_char + length(text))::INT AS end_char, length(text)::INT AS char_count, (length(text) // 4)::INT AS token_estimate FROM placed"
SENTENCE_CHUNKS = f"{SENTENCES}, {GATHERED}"
RECURSIVE_CHUNKS = f"{NESTED}, {GATHERED}"
SENTENCE_PLACED = PLACED.format(name="placed", chunks="chunks", first="greatest(strpos(t, text) - 1, 0) + length(text)", next="start_char + length(text)", since="greatest(0, w.next - length(c.text))")
RECURSIVE_PLACED = PLACED.format(name="placed", chunks="chunks", first="greatest(0, greatest(strpos(t, text) - 1, 0) + length(text) - 50)", next="greatest(next, start_char + length(text) - 50)", since="w.next")
_SUMS = "count(*) AS total_chunks, round(avg(length(text)), 1) AS avg_size, min(length(text))::BIGINT AS min_size, max(length(text))::BIGINT AS max_size"
PRICES = "prices AS (SELECT * FROM (VALUES " + ", ".join(f"('{m}', {i}::DECIMAL(9, 2), {o}::DECIMAL(9, 2))" for m, _, i, o in T.MODELS) + ") p(model, i, o))"
CALLS = f"""WITH {PRICES}, told AS (SELECT conv_id, turn, role, {_EST} AS tokens, {_MODEL} AS model,
  coalesce(sum({_EST}) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS input_tokens FROM conversations),
calls AS (SELECT conv_id * 1000 + turn AS request_id, model, input_tokens, tokens::BIGINT AS output_tokens,
  coalesce(input_tokens::DECIMAL(18, 0) * i * 0.000001, 0)::DECIMAL(38, 10) AS ic, coalesce(tokens::DECIMAL(18, 0) * o * 0.000001, 0)::DECIMAL(38, 10) AS oc, i IS NULL AS unknown FROM told LEFT JOIN prices USING (model) WHERE role = 'assistant'),
log AS (SELECT request_id, model, input_tokens, output_tokens, output_tokens * 1.5::DOUBLE + 10 AS latency_ms, round(ic + oc, 6)::DOUBLE AS total_cost, request_id % 9 = 0 AS failed FROM calls),
upto AS (SELECT * FROM log WHERE request_id <= (SELECT max(request_id) FROM log WHERE NOT failed) ORDER BY request_id DESC LIMIT {{most}}),
kept AS (SELECT * FROM upto UNION ALL SELECT * FROM log WHERE request_id > (SELECT max(request_id) FROM log WHERE NOT failed))
"""

SQL = {
    "chunk_fixed": CHUNKS + f"SELECT doc_id, index, text, start_char, ({_N} + start_char)::INT AS end_char, {_N}::INT AS char_count, ({_N} // 4)::INT AS token_estimate FROM chunks",
    "chunk_fixed_summary": CHUNKS + f"SELECT 'fixed' AS strategy, count(*) AS total_chunks, round(avg({_N}), 1) AS avg_size, min({_N})::BIGINT AS min_size, max({_N})::BIGINT AS max_size FROM chunks",
    "chunk_sentence": f"{_ONCE}, {SENTENCE_CHUNKS}, {SENTENCE_PLACED} {_SHOWN}",
    "chunk_recursive": f"{_ONCE}, {RECURSIVE_CHUNKS}, {RECURSIVE_PLACED} {_SHOWN}",
    "chunk_compare": f"""SELECT 'fixed' AS strategy, {_SUMS} FROM ({CHUNKS} SELECT text FROM chunks)
      UNION ALL SELECT 'sentence', {_SUMS} FROM ({_ONCE}, {SENTENCE_CHUNKS} SELECT text FROM chunks)
      UNION ALL SELECT 'recursive', {_SUMS} FROM ({_ONCE}, {RECURSIVE_CHUNKS} SELECT text FROM chunks)""",
    "token_estimates": f"SELECT doc_id, ({_EST})::BIGINT AS tokens FROM documents",
    "message_tokens": f"SELECT conv_id, (sum({_EST}) + 4 * count(*) + 2)::BIGINT AS tokens FROM conversations GROUP BY 1",
    "cost_by_call": CALLS.format(most=1) + "SELECT model, request_id, input_tokens, output_tokens, round(ic, 6)::DOUBLE AS input_cost, round(oc, 6)::DOUBLE AS output_cost, round(ic + oc, 6)::DOUBLE AS total_cost, CASE WHEN unknown THEN 'no price for model ''' || model || '''' ELSE '' END AS note FROM calls",
    "fits_context": f"SELECT doc_id, ['gpt-3.5-turbo', 'gpt-4o', 'unlisted'][(doc_id % 3)::INT + 1] AS model, [16385, 128000, 100000][(doc_id % 3)::INT + 1]::BIGINT AS context_window, {_EST} + 12000 <= context_window AS fits FROM documents",
    "valid_messages": "SELECT conv_id, turn, role FROM conversations WHERE role IN ('user', 'assistant') AND length(text) > 0",
    "mock_replies": r"""WITH r AS (SELECT conv_id, turn, '[System: ' || role || '] Mock response to: ' || replace(substr(text, 1, 50), chr(10), ' ') AS t FROM conversations WHERE role IN ('user', 'assistant') AND length(text) > 0),
      w AS (SELECT *, list_filter(string_split_regex(t, '\s+'), lambda x: x <> '') AS ws FROM r)
      SELECT conv_id, turn, CASE WHEN len(ws) > 10 THEN array_to_string(ws[1:10], ' ') ELSE t END AS reply FROM w""",
    "token_stream": r"""WITH w AS (SELECT conv_id * 1000 + turn AS id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS ws FROM conversations),
      t AS (SELECT id, list_append(list_transform(ws, lambda x: x || ' '), '[DONE]') AS ts FROM w)
      SELECT id, (unnest(range(0, len(ts))))::INT AS position, unnest(ts) AS token FROM t""",
    "usage_summary": CALLS.format(most=100) + """SELECT count(*) FILTER (NOT failed) AS total_requests, (sum(input_tokens) FILTER (NOT failed))::BIGINT AS total_input_tokens, (sum(output_tokens) FILTER (NOT failed))::BIGINT AS total_output_tokens,
      round(sum(total_cost) FILTER (NOT failed), 6) AS total_cost_usd, count(*) FILTER (failed) AS total_errors, (sum(input_tokens + output_tokens) FILTER (NOT failed))::BIGINT AS total_tokens,
      (SELECT round(avg(latency_ms), 2) FROM kept WHERE NOT failed) AS avg_latency_ms FROM log""",
    "usage_by_model": CALLS.format(most=1) + "SELECT model, count(*) AS requests, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, round(sum(total_cost), 6) AS total_cost FROM log WHERE NOT failed GROUP BY 1",
    "usage_recent": CALLS.format(most=1000) + "SELECT request_id, model, output_tokens, CASE WHEN failed THEN 'error' ELSE 'end_turn' END AS stop_reason FROM kept ORDER BY request_id DESC LIMIT 20",
    "usage_capped": CALLS.format(most=50) + "SELECT request_id, model FROM kept",
    "stream_usage_summary": f"SELECT {_MODEL} AS model, count(*) AS requests, 0::BIGINT AS input_tokens, sum({_EST})::BIGINT AS output_tokens FROM conversations WHERE role = 'assistant' GROUP BY 1",
    "stream_usage_by_model": CALLS.format(most=1) + "SELECT model, count(*) AS requests, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, round(sum(total_cost), 6) AS total_cost FROM log WHERE NOT failed GROUP BY 1",
    "stream_usage_ring": "SELECT 'mock' AS provider, conv_id * 1000 + turn AS request_id FROM conversations WHERE role = 'assistant' ORDER BY 2 DESC LIMIT 50",
    "chunk_token": r"""WITH RECURSIVE whole AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents),
      split AS (SELECT doc_id, regexp_extract_all(t, '\s*\S+') AS ts FROM whole),
      parts AS (SELECT doc_id, ts, unnest(range(0, len(ts), 236)) AS a FROM split),
      chunks AS (SELECT doc_id, (a // 236)::INT AS index, array_to_string(ts[a + 1:a + 256], '') AS text FROM parts),
      walk AS (
        SELECT doc_id, index, text, 0 AS start_char, greatest(0, length(text) - 20) AS next FROM chunks WHERE index = 0
        UNION ALL
        SELECT doc_id, index, text, next + greatest(p - 1, 0), greatest(next, next + greatest(p - 1, 0) + length(text) - 20)
        FROM (SELECT c.doc_id, c.index, c.text, w.next, strpos(substr(t, w.next + 1), c.text) AS p FROM walk w JOIN chunks c ON c.doc_id = w.doc_id AND c.index = w.index + 1 JOIN whole ON whole.doc_id = c.doc_id))
      SELECT doc_id, index, text, start_char::INT AS start_char, (start_char + length(text))::INT AS end_char, length(text)::INT AS char_count, (length(text) // 4)::INT AS token_estimate FROM walk""",
    "stream_event_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 2) AS value FROM events GROUP BY 1, 2",
}
