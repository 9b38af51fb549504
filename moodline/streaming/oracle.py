"""SQL (DuckDB dialect) for the streaming queries: every event is counted, and
one whose post cannot be scored has sentiment and band ``Error``."""

from __future__ import annotations


def streaming_sql() -> dict[str, str]:
    from moodline.plans.oracle import (BASE, LEVEL, MODEL, RULE_A, SCORED, _queries, model_ctes, score_ctes,
                                       with_ctes)

    n_docs = "(SELECT count(*) FROM documents)"
    doc_of = f"((e.event_id % {n_docs}) + {n_docs}) % {n_docs}"
    ev = f"""ev AS (
  SELECT e.event_id, e.ts, e.user_id, d.doc_id, sha256(d.text) AS text_hash,
         CASE WHEN pr.doc_id IS NULL THEN 'Error' ELSE {RULE_A.replace('p_', 'pr.p_')} END AS sentiment,
         CASE WHEN pr.doc_id IS NULL THEN 'Error' ELSE {LEVEL.replace('p_', 'pr.p_')} END AS toxicity_level
  FROM events e LEFT JOIN posts d ON d.doc_id = {doc_of} LEFT JOIN pr ON pr.doc_id = d.doc_id)"""
    q: dict[str, str] = {}
    q["stream_scored"] = with_ctes(*SCORED, ev) + """SELECT event_id, ts, user_id, doc_id, sentiment, toxicity_level
FROM ev"""
    q["toxicity_by_hour"] = with_ctes(*SCORED, ev) + """SELECT date_trunc('hour', ts) AS window_start,
       date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, toxicity_level, count(*) AS n_events
FROM ev GROUP BY 1, 2, 3"""
    q["user_sessions"] = with_ctes("""marked AS (
  SELECT user_id, ts,
         CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL
                OR ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE
              THEN 1 ELSE 0 END AS new_session
  FROM events)""", """numbered AS (
  SELECT user_id, ts, sum(new_session) OVER (PARTITION BY user_id ORDER BY ts
                                              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sid
  FROM marked)""") + """SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end,
       count(*) AS n_events
FROM numbered GROUP BY user_id, sid"""
    q["dedupe_per_minute"] = with_ctes(*SCORED, ev) + """SELECT date_trunc('minute', ts) AS minute_start, text_hash,
       sentiment, toxicity_level, min(event_id) AS first_event_id, count(*) AS n_requests
FROM ev GROUP BY 1, 2, 3, 4"""
    # the next fill of a text is its first request 60 s or more after this one
    q["cached_scores_stream"] = "WITH RECURSIVE " + with_ctes(*SCORED, ev, """steps AS (
  SELECT DISTINCT text_hash, sentiment, toxicity_level, ts,
         min(ts) OVER (PARTITION BY text_hash, sentiment, toxicity_level ORDER BY ts
                       RANGE BETWEEN INTERVAL 60 SECOND FOLLOWING AND UNBOUNDED FOLLOWING) AS following
  FROM ev)""", """fills AS (
  SELECT text_hash, sentiment, toxicity_level, min(ts) AS ts FROM steps GROUP BY ALL
  UNION ALL
  SELECT s.text_hash, s.sentiment, s.toxicity_level, s.following
  FROM fills f JOIN steps s ON s.text_hash IS NOT DISTINCT FROM f.text_hash AND s.sentiment = f.sentiment
       AND s.toxicity_level = f.toxicity_level AND s.ts = f.ts
  WHERE s.following IS NOT NULL)""").lstrip().removeprefix("WITH") + """SELECT f.text_hash, f.sentiment, f.toxicity_level,
       f.ts AS scored_at, f.ts + INTERVAL 60 SECOND AS expires_at, arg_min(e.event_id, (e.ts, e.event_id)) AS first_event_id,
       count(*) AS n_requests
FROM fills f JOIN ev e ON e.text_hash IS NOT DISTINCT FROM f.text_hash AND e.sentiment = f.sentiment
     AND e.toxicity_level = f.toxicity_level AND e.ts >= f.ts AND e.ts < f.ts + INTERVAL 60 SECOND
GROUP BY ALL"""
    q["stream_score_text"] = with_ctes(*MODEL, score_ctes("conversations", ["conv_id", "turn"], name="sp")) + f"""SELECT
       c.conv_id, c.turn,
       CASE WHEN s.conv_id IS NULL THEN 'Error' ELSE {RULE_A.replace('p_', 's.p_')} END AS sentiment,
       CASE WHEN s.conv_id IS NULL THEN 'Error' ELSE {LEVEL.replace('p_', 's.p_')} END AS toxicity_level,
       s.p_negative, s.p_neutral, s.p_positive
FROM conversations c LEFT JOIN sp s ON c.conv_id = s.conv_id AND c.turn = s.turn"""
    def versioned(version: int, alpha: float, rest: int) -> str:
        ctes = with_ctes(*BASE, model_ctes(alpha), score_ctes("conversations", ["conv_id", "turn"], name="sp"))
        return f"""SELECT * FROM ({ctes}SELECT c.conv_id, c.turn,
       CASE WHEN s.conv_id IS NULL THEN 'Error' ELSE {RULE_A.replace('p_', 's.p_')} END AS sentiment,
       CASE WHEN s.conv_id IS NULL THEN 'Error' ELSE {LEVEL.replace('p_', 's.p_')} END AS toxicity_level,
       s.p_negative, s.p_neutral, s.p_positive, {version} AS model_version
FROM conversations c LEFT JOIN sp s ON c.conv_id = s.conv_id AND c.turn = s.turn WHERE abs(c.conv_id % 2) = {rest})"""

    q["stream_model_change"] = versioned(1, 1.0, 0) + " UNION ALL " + versioned(2, 2.0, 1)
    # the streamed last-n state must end equal to the batch ranking
    q["history_last_n_stream"] = _queries()["history_last_n"]
    return q
