"""DuckDB restatements of the catalog queries (the correctness oracle).

Each string runs on the driver's pre-registered base tables; the
``interactions`` view is inlined as a CTE.  Repetitive column lists (40
counts, 64 encodings) are generated from the same name rules as the Spark
side; the arithmetic is restated in SQL, not shared.
"""

from __future__ import annotations

from ..schema import (ACTIONS, BIN_THRESHOLDS_FINAL, BIN_WEIGHTS, CLASS_WEIGHTS, COMBINED_TYPES, DEFAULT_SPLIT_TS, LABEL_COLS,
                      POST_TYPES, PROFILE_FIELDS, ROLES, TARGETS, count_col)
from ..sources.fixtures import interactions_cte

CUT = DEFAULT_SPLIT_TS


def R(x: str) -> str:
    return f"round(CAST({x} AS DOUBLE), 6)"


def uid(h: str) -> str:
    """Unsigned 64-bit fold of a hex id, as decimal text."""
    return f"CAST(('0x' || right({h}, 16))::UBIGINT AS VARCHAR)"


def bin_sql(c: str, th=BIN_THRESHOLDS_FINAL) -> str:
    parts = " ".join(f"WHEN {c} < {t} THEN {i + 1}" for i, t in enumerate(th))
    return f"CAST(CASE {parts} ELSE {len(th) + 1} END AS INTEGER)"


def has(c: str) -> str:
    return f"(coalesce({c}, 0) > 0)"


def train_pred(cut=CUT) -> str:
    return " AND ".join([f"ts < {cut}"] + [f"({c} < {cut} OR {c} IS NULL)" for c in LABEL_COLS])


def val_pred(cut=CUT) -> str:
    return " AND ".join([f"ts >= {cut}"] + [f"({c} >= {cut} OR {c} IS NULL)" for c in LABEL_COLS])


IDS = "tweet_id, a_user_id, b_user_id, ts"
W = interactions_cte()
WS = interactions_cte(with_score=True)


def signed_log1p(x: str) -> str:
    return f"(sign({x}) * ln(abs({x}) + 1))"


def ratio(n: str, d: str) -> str:
    return f"coalesce(CASE WHEN {d} = 0 THEN CASE WHEN {n} <> 0 THEN 1e7 END ELSE CAST({n} AS DOUBLE) / {d} END, -10)"


def media(kind: str) -> str:
    return (f"CASE WHEN medias IS NULL OR medias = '' THEN -1.0 ELSE "
            f"ln(1 + len(list_filter(string_split(medias, chr(9)), lambda x: x = '{kind}'))) END")


def epoch_date(ts: str) -> str:
    return f"(DATE '1970-01-01' + CAST(floor({ts} / 86400) AS INTEGER))"


# ------------------------------------------------------------------ user index

def role_rows_sql(src: str = "interactions") -> str:
    sel = []
    for r in ROLES:
        has_cols = ", ".join(f"{c} IS NOT NULL AS has_{t}" for t, c in zip(TARGETS, LABEL_COLS))
        sel.append(
            f"SELECT {uid(f'{r}_user_id')} AS user_id, '{r}' AS role, type, {r}_follower_count AS follower_count, "
            f"{r}_following_count AS following_count, {r}_is_verified AS verified, "
            f"{r}_account_creation AS account_creation, least(ts, {', '.join(LABEL_COLS)}) AS first_seen, {has_cols} "
            f"FROM {src}")
    return "\nUNION ALL\n".join(sel)


def typed_counts_sql(types=POST_TYPES) -> list[str]:
    out = []
    for t in types:
        for r in ROLES:
            for a in ACTIONS:
                cond = f"role = '{r}' AND type = '{t}'" + ("" if a == "present" else f" AND has_{a}")
                out.append(f"CAST(count_if({cond}) AS BIGINT) AS {count_col(a, r, t)}")
    return out


def combined_sql(types=COMBINED_TYPES) -> list[str]:
    return [f"({' + '.join(count_col(a, r, t) for t in types)}) AS {count_col(a, r)}" for r in ROLES for a in ACTIONS]


def user_index_sql(src: str = "interactions", active_only: bool = False, combined: bool = True) -> str:
    prof = ", ".join(f"{c} := {c}" for c in ["first_seen", *PROFILE_FIELDS])
    having = ("HAVING count_if(role = 'a' OR has_reply OR has_retweet OR has_retweet_comment OR has_like) > 0"
              if active_only else "")
    inner = (f"SELECT user_id, min(struct_pack({prof})) AS p, {', '.join(typed_counts_sql())}\n"
             f"FROM ({role_rows_sql(src)}) rr GROUP BY user_id {having}")
    typed = [count_col(a, r, t) for t in POST_TYPES for r in ROLES for a in ACTIONS]
    cols = ["user_id"] + [f"p.{c} AS {c}" for c in PROFILE_FIELDS] + typed + (combined_sql() if combined else [])
    return f"SELECT {', '.join(cols)} FROM ({inner}) g"


def te_slots(types=COMBINED_TYPES):
    return [(t, r, ty) for t in TARGETS for r in ROLES for ty in [*types, None]]


def slot(t, r, ty):
    return f"{t}_{r}" + (f"_{ty}" if ty else "")


def priors_sql(idx: str = "idx", skip: bool = False) -> str:
    cols = []
    for t, r, ty in te_slots():
        rate = f"CAST({count_col(t, r, ty)} AS DOUBLE) / NULLIF({count_col('present', r, ty)}, 0)"
        cols.append(f"avg({rate if skip else f'coalesce({rate}, 0)'}) AS prior_{slot(t, r, ty)}")
    return f"SELECT {', '.join(cols)} FROM {idx}"


def te_sql(idx: str = "idx", pr: str = "pr", keep_counts: bool = False, s: float = 20.0) -> str:
    cols = ["user_id"]
    if keep_counts:
        cols += [count_col(a, r, t) for t in POST_TYPES for r in ROLES for a in ACTIONS]
        cols += [count_col(a, r) for r in ROLES for a in ACTIONS]
    for t, r, ty in te_slots():
        n = f"CAST({count_col('present', r, ty)} AS DOUBLE)"
        rate = f"coalesce(CAST({count_col(t, r, ty)} AS DOUBLE) / NULLIF({count_col('present', r, ty)}, 0), 0)"
        cols.append(f"({n} * {rate} + {s} * prior_{slot(t, r, ty)}) / NULLIF({s} + {n}, 0) AS TE_{slot(t, r, ty)}")
    return f"SELECT {', '.join(cols)} FROM {idx} CROSS JOIN {pr}"


def enriched_sql(keep_counts: bool, sample: bool = False) -> str:
    count_names = ([count_col(a, r, t) for t in POST_TYPES for r in ROLES for a in ACTIONS]
                   + [count_col(a, r) for r in ROLES for a in ACTIONS]) if keep_counts else []
    te_names = [f"TE_{slot(*s)}" for s in te_slots()]
    sel = [IDS]
    for side, al in (("A", "ta"), ("B", "tb")):
        sel += [f"coalesce({al}.{c}, -10) AS {c}_{side}" for c in count_names]
        sel += [R(f"coalesce({al}.{c}, -10.0)") + f" AS {c}_{side}" for c in te_names]
    if sample:
        extra = ", idx AS (SELECT * FROM idx0 WHERE CAST(user_id AS UBIGINT) % 10000 < 5000)"
    else:
        extra = ", idx AS (SELECT * FROM idx0)"
    return (W + f", tr AS (SELECT * FROM interactions WHERE {train_pred()}),\n"
            f"idx0 AS ({user_index_sql('tr')}){extra},\n"
            f"pr AS ({priors_sql('idx')}),\n"
            f"te AS ({te_sql('idx', 'pr', keep_counts)}),\n"
            f"v AS (SELECT {IDS} FROM interactions WHERE {val_pred()})\n"
            f"SELECT {', '.join(sel)} FROM v LEFT JOIN te ta ON ta.user_id = {uid('v.a_user_id')} "
            f"LEFT JOIN te tb ON tb.user_id = {uid('v.b_user_id')}")


def _action_rows_sql() -> str:
    parts = []
    for r in ROLES:
        day = f"CAST(dayofyear({epoch_date('ts')}) AS INTEGER)" if r == "a" else "CAST(NULL AS INTEGER)"
        parts.append(f"SELECT {uid(f'{r}_user_id')} AS user_id, '{r}' AS role, 'present' AS action, type, ts AS event_ts, {day} AS day FROM interactions")
        for t, c in zip(TARGETS, LABEL_COLS):
            dd = f"CAST(dayofyear({epoch_date(c)}) AS INTEGER)" if r == "b" else "CAST(NULL AS INTEGER)"
            parts.append(f"SELECT {uid(f'{r}_user_id')} AS user_id, '{r}' AS role, '{t}' AS action, type, {c} AS event_ts, {dd} AS day FROM interactions WHERE {c} IS NOT NULL")
    return "\nUNION ALL\n".join(parts)


def _sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["positive_rate_by_bin"] = W + (
        f"SELECT {bin_sql('a_follower_count')} AS bin, CAST(count(*) AS BIGINT) AS n_rows, "
        + ", ".join(f"{R(f'avg(CASE WHEN {has(c)} THEN 1.0 ELSE 0.0 END)')} AS ctr_{t}" for t, c in zip(TARGETS, LABEL_COLS))
        + " FROM interactions GROUP BY 1")
    from ..sources.fixtures import INTERACTION_COLS
    q["null_audit"] = W + "SELECT " + ", ".join(f"CAST(count_if({c} IS NULL) AS BIGINT) AS {c}" for c in INTERACTION_COLS) + " FROM interactions"
    labs = ", ".join(LABEL_COLS)
    q["train_split"] = W + f"SELECT {IDS}, {labs} FROM interactions WHERE {train_pred()}"
    q["val_split"] = W + f"SELECT {IDS}, {labs} FROM interactions WHERE {val_pred()}"
    q["split_leftovers"] = W + f"SELECT {IDS}, {labs} FROM interactions WHERE NOT ({train_pred()}) AND NOT ({val_pred()})"
    q["features_log"] = W + (
        f"SELECT {IDS}, {R('ln(abs(a_follower_count) + 1)')} AS a_followers, {R('ln(abs(a_following_count) + 1)')} AS a_following, "
        f"{R('ln(abs(b_follower_count) + 1)')} AS b_followers, {R('ln(abs(b_following_count) + 1)')} AS b_following, "
        f"{R(signed_log1p('(a_account_creation - b_account_creation)'))} AS a_b_creation_delta, "
        f"{R(signed_log1p('(ts - a_account_creation)'))} AS a_creation_delta, "
        f"{R(signed_log1p('(ts - b_account_creation)'))} AS b_creation_delta, "
        + R("CASE WHEN abs(a_account_creation - b_account_creation) <= 1 THEN 0 ELSE sign(a_account_creation - b_account_creation) * ln(abs(a_account_creation - b_account_creation)) END")
        + " AS a_b_creation_symlog FROM interactions")
    q["features_ratio"] = W + (
        f"SELECT {IDS}, {R(ratio('a_follower_count', 'b_follower_count'))} AS a_b_follower_ratio, "
        f"{R(ratio('b_follower_count', 'a_follower_count'))} AS b_a_follower_ratio, "
        f"{R(ratio('a_following_count', 'b_following_count'))} AS a_b_following_ratio, "
        f"{R(ratio('b_following_count', 'a_following_count'))} AS b_a_following_ratio FROM interactions")
    q["features_media"] = W + (
        f"SELECT {IDS}, {R(media('Photo'))} AS photo_count, {R(media('Video'))} AS video_count, {R(media('GIF'))} AS gif_count, "
        "array_to_string(string_split(coalesce(medias, ''), chr(9))[1:3], '_') AS media_combo FROM interactions")
    q["features_text_len"] = W + (
        f"SELECT {IDS}, {R('ln(1 + len(string_split(tokens, chr(9))))')} AS bert_token_len, "
        "CAST(length(tokens) AS BIGINT) AS token_chars FROM interactions")
    q["features_calendar"] = W + (
        f"SELECT {IDS}, CAST(isodow({epoch_date('ts')}) - 1 AS INTEGER) AS day_of_week, "
        "CAST(((CAST(floor(ts / 3600) AS BIGINT) % 24) + 24) % 24 AS INTEGER) AS hour_of_day, "
        f"CAST(dayofyear({epoch_date('ts')}) AS INTEGER) AS day_of_year, "
        "strftime(TIMESTAMP '1970-01-01 00:00:00' + to_seconds(ts), '%Y-%m-%d %H:%M:%S') AS readable_ts FROM interactions")
    q["features_codes"] = W + (
        ", d AS (SELECT language AS value, CAST(dense_rank() OVER (ORDER BY language) - 1 AS BIGINT) AS code "
        "FROM (SELECT DISTINCT language FROM interactions WHERE language IS NOT NULL) x)\n"
        f"SELECT {IDS}, CAST(CASE type WHEN 'Retweet' THEN 0 WHEN 'Quote' THEN 1 WHEN 'Reply' THEN 2 WHEN 'TopLevel' THEN 3 END AS INTEGER) AS type_encoding, "
        "coalesce(d.code, -1) AS language_encoding FROM interactions i LEFT JOIN d ON i.language = d.value")
    q["engagement_latency"] = W + (
        f"SELECT {IDS}, " + ", ".join(f"CAST(CASE WHEN {has(c)} THEN {c} - ts ELSE 0 END AS BIGINT) AS {t}_latency"
                                      for t, c in zip(TARGETS, LABEL_COLS)) + " FROM interactions")
    q["id_fold64"] = W + (
        f"SELECT tweet_id, {uid('a_user_id')} AS a_uid64, {uid('b_user_id')} AS b_uid64, {uid('b_user_id')} AS b_uid64_from_key FROM interactions")
    h32 = lambda c: f"CAST(('0x' || right({c}, 8))::UBIGINT AS BIGINT)"
    q["id_hash32"] = W + f"SELECT tweet_id, {h32('tweet_id')} AS tweet_hash, {h32('a_user_id')} AS a_hash, {h32('b_user_id')} AS b_hash FROM interactions"

    q["action_unpivot"] = W + f"SELECT *, concat_ws('_', 'n', action, role, type) AS action_type FROM ({_action_rows_sql()}) x"
    q["user_action_counts"] = W + (
        f"SELECT user_id, concat_ws('_', 'n', action, role, type) AS action_type, CAST(count(*) AS BIGINT) AS n "
        f"FROM ({_action_rows_sql()}) x GROUP BY 1, 2")
    q["user_index"] = W + user_index_sql()
    q["user_index_active_only"] = W + user_index_sql(active_only=True)
    q["user_day_counts"] = W + (
        f"SELECT user_id, day, CAST(count(*) AS BIGINT) AS n FROM ({_action_rows_sql()}) x WHERE day IS NOT NULL GROUP BY 1, 2")
    q["index_merge"] = W + user_index_sql(combined=False)
    tr = f", tr AS (SELECT * FROM interactions WHERE {train_pred()}), idx AS ({user_index_sql('tr')})\n"
    q["te_priors_skip"] = W + tr + ", p AS (" + priors_sql("idx", skip=True) + ")\nSELECT " + ", ".join(
        f"{R(f'prior_{slot(*s)}')} AS prior_{slot(*s)}" for s in te_slots()) + " FROM p"
    q["te_priors_zero"] = W + tr + ", p AS (" + priors_sql("idx") + ")\nSELECT " + ", ".join(
        f"{R(f'prior_{slot(*s)}')} AS prior_{slot(*s)}" for s in te_slots()) + " FROM p"
    q["te_user"] = W + tr + f", pr AS ({priors_sql('idx')}), te AS ({te_sql('idx', 'pr')})\nSELECT user_id, " + ", ".join(
        f"{R(f'TE_{slot(*s)}')} AS TE_{slot(*s)}" for s in te_slots()) + " FROM te"
    q["enriched_interactions"] = enriched_sql(keep_counts=True)
    q["enriched_sampled_users"] = enriched_sql(keep_counts=False, sample=True)
    return q


def _has_cols() -> str:
    return ", ".join(f"{has(c)} AS has_{t}" for t, c in zip(TARGETS, LABEL_COLS))


def D(b: str) -> str:
    return f"CAST({b} AS DOUBLE)"


def _labelled_cte(score: bool = False) -> str:
    base = interactions_cte(with_score=score).split("(", 1)[1].rsplit(")", 1)[0]
    return f"WITH interactions AS (SELECT *, {_has_cols()} FROM ({base}) base)\n"


def _quintile_sql(part: bool) -> str:
    pk = "part, " if part else ""
    pp = "PARTITION BY part " if part else ""
    bounds = " + ".join(f"CASE WHEN floor({D(str(j / 5))} * n) <= pos THEN 1 ELSE 0 END" for j in range(1, 6))
    src = ("(SELECT *, year(" + epoch_date("ts") + ") AS part FROM interactions)") if part else "interactions"
    return (f", st AS (SELECT {pk}a_user_id, avg(CAST(a_follower_count AS DOUBLE)) AS mean, count(*) AS cnt FROM {src} x GROUP BY ALL),\n"
            f"r AS (SELECT *, row_number() OVER ({pp}ORDER BY mean, a_user_id) - 1 AS pos, count(*) OVER ({pp}) AS n FROM st),\n"
            f"g AS (SELECT *, CAST(1 + {bounds} AS INTEGER) AS quintile FROM r),\n"
            f"pg AS (SELECT {pk}quintile, max(mean) AS gmax, avg(CAST(cnt AS DOUBLE)) AS avg_count, CAST(count(*) AS BIGINT) AS n_users FROM g GROUP BY ALL),\n"
            f"q AS (SELECT {pk}quintile, avg_count, n_users, max(gmax) OVER ({pp}ORDER BY quintile ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upper_mean FROM pg)\n")


def _index_onehot() -> str:
    bins = ", ".join(f"CAST(bin = {b} AS INTEGER) AS bin{b}" for b in range(1, 6))
    return (f", idx AS ({user_index_sql()}),\n"
            f"oh AS (SELECT user_id, n_present_a AS n_present, bin, {bins} FROM "
            f"(SELECT *, {bin_sql('follower_count')} AS bin FROM idx WHERE n_present_a > 0) z)\n")


def _metric_rows() -> str:
    sel = "\nUNION ALL\n".join(
        f"SELECT {bin_sql('a_follower_count')} AS bin, '{t}' AS target, score, CAST(has_{t} AS INTEGER) AS y FROM interactions"
        for t in TARGETS)
    return f", m AS ({sel})\n"


def _rce_sql(group: str) -> str:
    ll = "-(y * ln(greatest(least(score, 1 - 1e-15), 1e-15)) + (1 - y) * ln(1 - greatest(least(score, 1 - 1e-15), 1e-15)))"
    return (f"SELECT {group}, CAST(count(*) AS BIGINT) AS n, avg(CAST(y AS DOUBLE)) AS ctr, avg({ll}) AS log_loss FROM m GROUP BY ALL")


def _rce_select(src: str) -> str:
    straw = "-(ctr * ln(ctr) + (1 - ctr) * ln(1 - ctr))"
    return f"SELECT *, CASE WHEN ctr > 0 AND ctr < 1 THEN (1 - log_loss / {straw}) * 100 END AS rce FROM ({src}) rr"


def _ap_sql(group: str) -> str:
    return (f"SELECT {group}, sum(tp * cum_tp / cum_cnt) / NULLIF(sum(tp), 0) AS ap, CAST(sum(tp) AS BIGINT) AS positives FROM ("
            f"SELECT *, sum(tp) OVER (PARTITION BY {group} ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cum_tp, "
            f"sum(cnt) OVER (PARTITION BY {group} ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cum_cnt FROM ("
            f"SELECT {group}, score, CAST(sum(y) AS DOUBLE) AS tp, CAST(count(*) AS DOUBLE) AS cnt FROM m GROUP BY ALL) t) c GROUP BY ALL")


def unit_hash_sql(cols: list[str], salt: str) -> str:
    parts = ", ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in cols)
    return f"(CAST(('0x' || substr(md5(concat_ws('|', '{salt}', {parts})), 1, 8))::UBIGINT AS DOUBLE) / 4294967296.0)"


def _sql2() -> dict[str, str]:
    q: dict[str, str] = {}
    L = _labelled_cte()
    q["te_group_type"] = L + (
        ", st AS (SELECT type, count(*) AS cnt, avg(CAST(has_like AS DOUBLE)) AS mean FROM interactions GROUP BY 1), "
        "tot AS (SELECT avg(CAST(has_like AS DOUBLE)) AS total_mean FROM interactions)\n"
        f"SELECT {IDS}, type, {R('coalesce((cnt * mean + 20.0 * total_mean) / (cnt + 20.0), -1.0)')} AS TE_type_like "
        "FROM interactions LEFT JOIN st USING (type) CROSS JOIN tot")
    q["te_group_language"] = L + (
        ", st AS (SELECT language, count(*) AS cnt, avg(CAST(has_reply AS DOUBLE)) AS mean FROM interactions GROUP BY 1), "
        "tot AS (SELECT avg(CAST(has_reply AS DOUBLE)) AS total_mean FROM interactions)\n"
        f"SELECT {IDS}, language, {R('coalesce((cnt * mean + 20.0 * total_mean) / (cnt + 20.0), -1.0)')} AS TE_language_reply "
        "FROM interactions LEFT JOIN st USING (language) CROSS JOIN tot")
    q["te_apply_val"] = L + (
        f", tr AS (SELECT * FROM interactions WHERE {train_pred()}), va AS (SELECT * FROM interactions WHERE {val_pred()}),\n"
        "st AS (SELECT language, type, count(*) AS cnt, avg(CAST(has_retweet AS DOUBLE)) AS mean FROM tr GROUP BY 1, 2), "
        "tot AS (SELECT avg(CAST(has_retweet AS DOUBLE)) AS total_mean FROM tr),\n"
        "enc AS (SELECT language, type, (cnt * mean + 20.0 * total_mean) / (cnt + 20.0) AS e FROM st CROSS JOIN tot)\n"
        f"SELECT {IDS}, language, type, {R('coalesce(e, -1.0)')} AS TE_lang_type_retweet FROM va LEFT JOIN enc USING (language, type)")
    q["cond_prob"] = L + (
        f", b AS (SELECT *, {bin_sql('a_follower_count')} AS bin FROM interactions),\n"
        "mg AS (SELECT has_reply, has_like, count(*) AS marginal FROM b GROUP BY 1, 2),\n"
        "jt AS (SELECT has_reply, has_like, type, bin, count(*) AS joint FROM b GROUP BY 1, 2, 3, 4)\n"
        f"SELECT has_reply, has_like, type, bin, CAST(joint AS BIGINT) AS joint, CAST(marginal AS BIGINT) AS marginal, "
        f"{R('CAST(joint AS DOUBLE) / marginal')} AS probability FROM jt LEFT JOIN mg USING (has_reply, has_like)")
    dr = lambda col, src: (f"SELECT {col} AS value, CAST(dense_rank() OVER (ORDER BY {col}) - 1 AS BIGINT) AS code "  # noqa: E731
                           f"FROM (SELECT DISTINCT {col} FROM {src} WHERE {col} IS NOT NULL) x")
    q["dict_language"] = W + dr("language", "interactions")
    q["dict_users"] = W + ", u AS (SELECT a_user_id AS user_id FROM interactions UNION SELECT b_user_id FROM interactions)\n" + dr("user_id", "u")
    items = ("SELECT DISTINCT v AS value FROM (SELECT unnest(string_split(hashtags, chr(9))) AS v FROM interactions "
             "WHERE hashtags IS NOT NULL) x WHERE v <> ''")
    q["distinct_hashtags"] = W + items
    q["hashtags_encoded"] = W + (
        f", it AS ({items}), d AS ({dr('value', 'it')}),\n"
        "cells AS (SELECT DISTINCT hashtags FROM interactions WHERE hashtags IS NOT NULL),\n"
        "ex AS (SELECT hashtags, unnest(string_split(hashtags, chr(9))) AS v, generate_subscripts(string_split(hashtags, chr(9)), 1) AS pos FROM cells),\n"
        "m AS (SELECT hashtags, string_agg(CAST(code AS VARCHAR), ',' ORDER BY pos) AS codes FROM ex JOIN d ON ex.v = d.value GROUP BY 1)\n"
        "SELECT i.tweet_id, i.b_user_id, i.ts, i.hashtags, coalesce(m.codes, '') AS codes FROM interactions i LEFT JOIN m ON i.hashtags = m.hashtags")
    tok = "SELECT DISTINCT v AS value FROM (SELECT unnest(string_split(tokens, chr(9))) AS v FROM interactions WHERE tokens IS NOT NULL) x WHERE v <> ''"
    q["tokens_decoded"] = W + (
        f", it AS ({tok}), d AS ({dr('value', 'it')}),\n"
        "cells AS (SELECT DISTINCT tokens FROM interactions WHERE tokens IS NOT NULL),\n"
        "ex AS (SELECT tokens, unnest(string_split(tokens, chr(9))) AS v, generate_subscripts(string_split(tokens, chr(9)), 1) AS pos FROM cells),\n"
        "m AS (SELECT tokens, string_agg(CAST(code AS VARCHAR), chr(9) ORDER BY pos) AS token_ids, string_agg(value, ' ' ORDER BY pos) AS text "
        "FROM ex JOIN d ON ex.v = d.value GROUP BY 1)\n"
        "SELECT i.tweet_id, i.b_user_id, i.ts, i.tokens, coalesce(m.token_ids, '') AS token_ids, coalesce(m.text, '') AS text "
        "FROM interactions i LEFT JOIN m ON i.tokens = m.tokens")
    combo = "array_to_string(string_split(coalesce(medias, ''), chr(9))[1:3], '_')"
    q["combo_media_codes"] = W + (
        f", c AS (SELECT DISTINCT {combo} AS media_combo FROM interactions)\n"
        "SELECT media_combo, CAST(dense_rank() OVER (ORDER BY media_combo) - 1 AS BIGINT) AS code FROM c")
    q["follower_quintiles"] = W + _quintile_sql(False) + (
        f"SELECT quintile, {R('avg_count')} AS avg_count, n_users, {R('upper_mean')} AS upper_mean FROM q")
    q["quintiles_by_part"] = W + _quintile_sql(True) + (
        f"SELECT quintile, {R('avg(upper_mean)')} AS upper_mean, {R('avg(avg_count)')} AS avg_count, CAST(count(*) AS BIGINT) AS n_parts FROM q GROUP BY 1")
    q["class_weights"] = L + ", r AS (" + " UNION ALL ".join(
        f"SELECT '{t}' AS target, avg(CAST(has_{t} AS DOUBLE)) AS p FROM interactions" for t in TARGETS) + ")\n" + (
        f"SELECT target, {R('p')} AS positive_rate, {R('(1 / NULLIF(1 - p, 0)) / (1 / NULLIF(1 - p, 0) + 1 / NULLIF(p, 0))')} AS weight_neg, "
        f"{R('(1 / NULLIF(p, 0)) / (1 / NULLIF(1 - p, 0) + 1 / NULLIF(p, 0))')} AS weight_pos FROM r")
    h32 = "CAST(('0x' || right(b_user_id, 8))::UBIGINT AS BIGINT)"
    q["dup_hashes"] = W + (f"SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT {h32}) AS BIGINT) AS n_distinct, "
                           f"CAST(count(*) - count(DISTINCT {h32}) AS BIGINT) AS n_duplicates FROM interactions")
    rd = lambda c: f"strftime(TIMESTAMP '1970-01-01 00:00:00' + to_seconds({c}), '%Y-%m-%d %H:%M:%S')"
    q["time_range"] = W + f"SELECT min_ts, max_ts, {rd('min_ts')} AS min_readable, {rd('max_ts')} AS max_readable FROM (SELECT min(ts) AS min_ts, max(ts) AS max_ts FROM interactions) t"
    q["longest_text"] = ("SELECT lang, doc_id, CAST(n AS BIGINT) AS n_chars FROM (SELECT lang, doc_id, length(text) AS n, "
                         "row_number() OVER (PARTITION BY lang ORDER BY length(text) DESC, doc_id ASC) AS rk FROM documents) x WHERE rk = 1")
    q["bins_onehot"] = W + _index_onehot() + "SELECT * FROM oh"
    shares = ", ".join(f"{R(f'avg(bin{b})')} AS share_bin{b}, {R(f'avg(bin{b}) * count(*)')} AS users_bin{b}" for b in range(1, 6))
    q["activity_distribution"] = W + _index_onehot() + f"SELECT n_present, CAST(count(*) AS BIGINT) AS n_users, {shares} FROM oh GROUP BY 1"
    q["activity_histogram"] = W + _index_onehot() + (
        ", mm AS (SELECT min(n_present) AS lo, max(n_present) AS hi FROM oh)\n"
        "SELECT CAST(CASE WHEN hi = lo THEN 1 ELSE least(floor(CAST(n_present - lo AS DOUBLE) / (hi - lo) * 130) + 1, 130) END AS INTEGER) AS bucket, "
        "bin, CAST(count(*) AS BIGINT) AS n_users FROM oh CROSS JOIN mm GROUP BY 1, 2")
    q["topk_users"] = W + f", idx AS ({user_index_sql()})\nSELECT user_id, n_present_a, n_present_b FROM idx ORDER BY n_present_a DESC, user_id ASC LIMIT 10"
    q["prior_model"] = L + (
        f", pri AS (SELECT " + ", ".join(f"avg(CAST(has_{t} AS DOUBLE)) AS prior_{t}" for t in TARGETS)
        + f" FROM interactions WHERE {train_pred()})\n"
        f"SELECT tweet_id, b_user_id, " + ", ".join(f"{R(f'prior_{t}')} AS prior_{t}" for t in TARGETS)
        + f" FROM interactions CROSS JOIN pri WHERE {val_pred()}")
    M = _labelled_cte(score=True) + _metric_rows()
    q["rce_by_bin"] = M + f"SELECT bin, target, n, {R('ctr')} AS ctr, {R('log_loss')} AS log_loss, {R('rce')} AS rce FROM ({_rce_select(_rce_sql('bin, target'))}) z"
    q["ap_by_bin"] = M + f"SELECT bin, target, {R('ap')} AS ap, positives FROM ({_ap_sql('bin, target')}) z"
    q["metrics_macro"] = M + (
        f", r AS ({_rce_select(_rce_sql('bin, target'))}), a AS ({_ap_sql('bin, target')})\n"
        f"SELECT target, {R('avg(rce)')} AS macro_rce, {R('avg(ap)')} AS macro_ap, CAST(count_if(rce IS NULL) AS BIGINT) AS undefined_bins "
        "FROM r FULL JOIN a USING (bin, target) GROUP BY 1")
    q["metrics_overall"] = M + (
        f", r AS ({_rce_select(_rce_sql('target'))}), a AS ({_ap_sql('target')})\n"
        f"SELECT target, n, {R('ctr')} AS ctr, {R('log_loss')} AS log_loss, {R('rce')} AS rce, {R('ap')} AS ap, positives FROM r FULL JOIN a USING (target)")
    q["confusion"] = M + "SELECT target, y, CAST(round_even(score, 0) AS INTEGER) AS y_hat, CAST(count(*) AS BIGINT) AS n FROM m GROUP BY ALL"
    q["balanced_accuracy"] = M + (
        ", c AS (SELECT target, count_if(y = 1 AND yh = 1) AS tp, count_if(y = 0 AND yh = 0) AS tn, count_if(y = 0 AND yh = 1) AS fp, "
        "count_if(y = 1 AND yh = 0) AS fn FROM (SELECT *, CAST(round_even(score, 0) AS INTEGER) AS yh FROM m) z GROUP BY 1)\n"
        f"SELECT target, {R('CAST(tp + tn AS DOUBLE) / (tp + tn + fp + fn)')} AS accuracy, "
        f"{R('(CAST(tp AS DOUBLE) / NULLIF(tp + fn, 0) + CAST(tn AS DOUBLE) / NULLIF(tn + fp, 0)) / 2')} AS balanced_accuracy, "
        f"{R('CAST(tp AS DOUBLE) / NULLIF(tp + fp, 0)')} AS precision FROM c")
    sc = ["a_follower_count", "b_follower_count", "a_following_count", "b_following_count"]
    q["minmax_scaled"] = W + (
        ", st AS (SELECT " + ", ".join(f"CAST(min({c}) AS DOUBLE) AS lo_{c}, CAST(max({c}) AS DOUBLE) AS hi_{c}" for c in sc)
        + f" FROM interactions WHERE {train_pred()})\n"
        f"SELECT {IDS}, " + ", ".join(f"{R(f'coalesce(({c} - lo_{c}) / NULLIF(hi_{c} - lo_{c}, 0), 0.0)')} AS {c}" for c in sc)
        + f" FROM interactions CROSS JOIN st WHERE {val_pred()}")
    key = ["tweet_id", "b_user_id", "ts"]
    ua, ub = unit_hash_sql(key, "author"), unit_hash_sql(key, "consumer")
    q["mask_columns"] = W + (
        f"SELECT {IDS}, CASE WHEN {ua} < 0.75 THEN -1 ELSE a_follower_count END AS a_follower_count, "
        f"CASE WHEN {ub} < 0.75 THEN -1 ELSE b_follower_count END AS b_follower_count, "
        f"CASE WHEN {ua} < 0.75 THEN -1 ELSE a_following_count END AS a_following_count, "
        f"CASE WHEN {ub} < 0.75 THEN -1 ELSE b_following_count END AS b_following_count FROM interactions")
    q["hash_split"] = W + f"SELECT {IDS}, CASE WHEN {unit_hash_sql(key, 'split')} < 0.85 THEN 'train' ELSE 'test' END AS split FROM interactions"
    q["row_ids"] = W + ("SELECT tweet_id, b_user_id, ts, type, CAST(row_number() OVER (ORDER BY ts, tweet_id, b_user_id, type) AS BIGINT) AS row_id "
                        "FROM interactions")
    return q


def _roundtrips(q: dict[str, str]) -> dict[str, str]:
    """Oracles of ``roundtrips``: what was written is what the view has."""
    from ..schema import ALL_COLS, TARGETS, USER_CENTRIC_COLS
    from .roundtrips import BATCH, FIRST
    text = lambda c: f"coalesce(CAST({c} AS VARCHAR), '') AS {c}"
    out = {
        "log_roundtrip": W + f"SELECT {', '.join(ALL_COLS)} FROM interactions",
        "user_columns_roundtrip": W + f"SELECT {', '.join(USER_CENTRIC_COLS)} FROM interactions",
        "lines_roundtrip": W + f"SELECT {', '.join(map(text, ALL_COLS))} FROM interactions",
        "index_roundtrip": W + user_index_sql("interactions"),
        "predictions_roundtrip": interactions_cte(True) + "SELECT tweet_id, b_user_id AS user_id, " + ", ".join(f"score AS {t}" for t in TARGETS) + " FROM interactions",
        "dictionary_roundtrip": q["dict_language"],
        "stats_roundtrip": W + (
            f", s AS (SELECT type, count(*) AS n, avg(CAST(like_ts IS NOT NULL AS DOUBLE)) AS m FROM interactions WHERE {train_pred()} GROUP BY 1),\n"
            f"t AS (SELECT avg(CAST(like_ts IS NOT NULL AS DOUBLE)) AS tm FROM interactions WHERE {train_pred()})\n"
            "SELECT tweet_id, b_user_id, ts, i.type, round(coalesce((n * m + 20.0 * tm) / (n + 20.0), -1.0), 6) AS te\n"
            f"FROM (SELECT * FROM interactions WHERE {val_pred()}) i LEFT JOIN (SELECT * FROM s CROSS JOIN t) st ON i.type = st.type"),
        "first_batches_rows": W + (
            f"SELECT tweet_id, b_user_id, ts, type, CAST(floor(rn / {BATCH}) AS BIGINT) AS batch_id FROM (SELECT *, "
            f"row_number() OVER (ORDER BY ts, tweet_id, b_user_id, type) - 1 AS rn FROM interactions) x WHERE rn < {BATCH * FIRST}"),
    }
    out["training_table_train"] = _training_table_sql(train_pred())
    out.update(_reproducible(q))
    out.update(_helpers(q, out))
    return out


def _helpers(q: dict[str, str], done: dict[str, str]) -> dict[str, str]:
    """Oracles of reading, writing and column helpers."""
    from ..schema import ALL_COLS, FEATURE_COLS
    from .catalog import DROPPED_FEATURES
    from .roundtrips import EXTENSION_PARTS, VERSIONED
    read = ", ".join(f"'{t}'" for part in EXTENSION_PARTS[:2] for t in part)
    left_out = ", ".join(f"'{c}'" for c in DROPPED_FEATURES)
    dow = f"CAST(isodow({epoch_date('ts')}) - 1 AS INTEGER)"
    return {
        "unlabelled_roundtrip": W + f"SELECT {', '.join(FEATURE_COLS)} FROM interactions",
        "extension_listing": W + f"SELECT {', '.join(ALL_COLS)} FROM interactions WHERE type IN ({read})",
        "coloaded_features": W + (
            f"SELECT CAST(row_number() OVER (ORDER BY {', '.join(VERSIONED)}) - 1 AS BIGINT) AS idx, {R('ln(abs(a_follower_count) + 1)')} AS a_followers, "
            "CAST((ts // 3600) % 24 AS INTEGER) AS hour, tweet_id, b_user_id, ts FROM interactions"),
        "run_log_ranked": "SELECT target AS method, accuracy, CAST(row_number() OVER (ORDER BY accuracy DESC NULLS LAST, target) AS BIGINT) AS rank "
            f"FROM ({q['balanced_accuracy']}) x",
        "manifest_columns": done["index_roundtrip"],
        "training_table_no_index": f"SELECT COLUMNS(lambda c: NOT starts_with(c, 'TE_') AND c NOT IN ({left_out})) FROM ({_training_table_sql(val_pred() + ' AND like_ts IS NOT NULL')}) x",
        "index_without_counts": f"SELECT COLUMNS(lambda c: NOT starts_with(c, 'n_reply')) FROM ({q['user_index']}) x",
        "label_safe_features": W + (
            f"SELECT tweet_id, b_user_id, ts, {R('ln(abs(a_follower_count) + 1)')} AS a_followers, {dow} AS day_of_week, b AS bin, CAST(b * b AS INTEGER) AS bin_squared "
            f"FROM (SELECT *, {bin_sql('a_follower_count')} AS b FROM interactions) x"),
        "widened_counts": W + "SELECT language, CAST(sum(a_follower_count) AS BIGINT) AS a_total, CAST(sum(b_follower_count) AS BIGINT) AS b_total, "
            "CAST(sum(ts) AS VARCHAR) AS ts_total FROM interactions GROUP BY language",
    }


def uniform_sql(key: list[str], j: int, seed: int) -> str:
    """Uniform ``j`` of a row's counter-based generator: four to a block."""
    parts = ", ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in key)
    h = f"substr(md5(concat_ws('|', 'u{seed}.{j // 4}', {parts})), {8 * (j % 4) + 1}, 8)"
    return f"((CAST(('0x' || {h})::UBIGINT AS DOUBLE) + 0.5) / 4294967296.0)"


def normal_sql(key: list[str], j: int, seed: int) -> str:
    """Standard normal ``j`` of a row by Box-Muller: a pair of uniforms gives a cosine and a sine."""
    first = j - j % 2
    turn = f"2 * pi() * {uniform_sql(key, first + 1, seed)}"
    return f"(sqrt(-2.0 * ln({uniform_sql(key, first, seed)})) * {'sin' if j % 2 else 'cos'}({turn}))"


def _reproducible(q: dict[str, str]) -> dict[str, str]:
    """Oracles of noise, weights, boosting steps, lookups, versions, positions and streamed windows."""
    from .roundtrips import MINI, MINI_BATCH, ROW, STREAM_LATE, STREAM_MIDDLE, VERSIONED, lookup_ids
    key = ["tweet_id", "b_user_id"]
    L = _labelled_cte() + f", tr AS (SELECT *, {bin_sql('a_follower_count')} AS bin FROM interactions WHERE {train_pred()})\n"
    row = ", ".join(ROW)
    w = f"4.0 * ({bin_weight_sql('bin')}) * CASE WHEN has_reply THEN {CLASS_WEIGHTS['reply'][1]!r} ELSE {CLASS_WEIGHTS['reply'][0]!r} END"
    steps = ", ".join(f"{R(f'sum(s_{t} - CAST(has_{t} AS INT))')} AS g_{t}, {R(f'sum(s_{t} * (1 - s_{t}))')} AS h_{t}" for t in TARGETS)
    return {
        "noise_te": _training_table_sql(train_pred(), noise=0.05),
        "random_scores": W + f"SELECT {', '.join(key)}, " + ", ".join(f"{R(uniform_sql(key, i, 7))} AS score_{t}" for i, t in enumerate(TARGETS))
            + f" FROM interactions WHERE {val_pred()}",
        "balanced_class_weights": L + "SELECT " + ", ".join(
            f"{R(f'count(*) / (2.0 * nullif(count_if({n}has_{t}), 0))')} AS w_{t}_{k}" for t in TARGETS for k, n in ((0, 'NOT '), (1, ''))) + " FROM tr",
        "weight_replicas": L + (
            f", wt AS (SELECT *, {w} AS w, {uniform_sql(['tweet_id', 'b_user_id', 'ts'], 0, 3)} AS u FROM tr), "
            "c AS (SELECT *, CAST(floor(w) AS BIGINT) + CASE WHEN u < w - floor(w) THEN 1 ELSE 0 END AS k FROM wt)\n"
            "SELECT bin, has_reply, CAST(sum(k) AS BIGINT) AS copies, CAST(count(DISTINCT (tweet_id, b_user_id, ts)) AS BIGINT) AS n_rows "
            "FROM c WHERE k > 0 GROUP BY bin, has_reply"),
        "boosting_steps": L + ", s AS (SELECT " + ", ".join(f"avg(CAST(has_{t} AS DOUBLE)) AS s_{t}" for t in TARGETS)
            + f" FROM tr)\nSELECT bin, {steps} FROM tr CROSS JOIN s GROUP BY bin",
        "enriched_bucketed": q["enriched_interactions"],
        "user_point_lookup": f"SELECT * FROM ({q['user_index']}) x WHERE user_id IN (" + ", ".join(uid(f"'{u}'") for u in lookup_ids()) + ")",
        "additive_features": W + (
            f"SELECT CAST(row_number() OVER (ORDER BY {', '.join(VERSIONED)}) AS BIGINT) AS row_id, tweet_id, {R('ln(abs(a_follower_count) + 1)')} AS a_followers, "
            f"{R('ln(1 + len(string_split(tokens, chr(9))))')} AS bert_token_len, CAST(length(tokens) AS BIGINT) AS token_chars FROM interactions"),
        "minibatch_ids": W + (
            f"SELECT {row}, CAST(floor(rn / {MINI_BATCH}) AS BIGINT) AS batch_id, CAST(floor((rn % {MINI_BATCH}) / {MINI}) AS BIGINT) AS minibatch_id "
            f"FROM (SELECT *, row_number() OVER (ORDER BY {row}) - 1 AS rn FROM interactions) x"),
        # A row is late if its window had ended, two days back from the latest event, before its folder came in.
        "stream_day_windows": (
            f"WITH ev AS (SELECT user_id, floor(epoch(ts)) AS s, floor(epoch(ts) / 86400) * 86400 AS day, event_id % {STREAM_LATE} = 0 AS last_folder FROM events), "
            "marks AS (SELECT max(s) FILTER (NOT last_folder) - 172800 AS before, max(s) - 172800 AS after FROM ev)\n"
            "SELECT user_id, CAST(day AS BIGINT) AS day_start, CAST(count(*) AS BIGINT) AS n FROM ev CROSS JOIN marks "
            "WHERE NOT (last_folder AND day + 86400 <= before) AND day + 86400 <= after GROUP BY user_id, day"),
    }


def bin_weight_sql(c: str) -> str:
    return f"CASE {c} " + " ".join(f"WHEN {k} THEN {v!r}" for k, v in BIN_WEIGHTS.items()) + " END"


def _training_table_sql(rows: str | None = None, noise: float | None = None) -> str:
    te_names = [f"TE_{slot(*s)}" for s in te_slots()]
    tcase = "CASE type WHEN 'Retweet' THEN 0 WHEN 'Quote' THEN 1 WHEN 'Reply' THEN 2 WHEN 'TopLevel' THEN 3 END"
    sel = ["v.tweet_id", "v.b_user_id", "a_follower_count", "a_following_count", "a_is_verified", "b_follower_count",
           "b_following_count", "b_is_verified", "a_follows_b"]
    sel += [f"coalesce({c}, 0) AS {c}" for c in LABEL_COLS]
    sel += [f"{R('ln(1 + len(string_split(tokens, chr(9))))')} AS bert_token_len",
            f"{R(media('Photo'))} AS photo_count", f"{R(media('Video'))} AS video_count", f"{R(media('GIF'))} AS gif_count",
            f"CAST(coalesce({tcase}, -10) AS INTEGER) AS type_encoding",
            f"{R('ln(abs(a_follower_count) + 1)')} AS a_followers", f"{R('ln(abs(a_following_count) + 1)')} AS a_following",
            f"{R('ln(abs(b_follower_count) + 1)')} AS b_followers", f"{R('ln(abs(b_following_count) + 1)')} AS b_following",
            f"CAST(isodow({epoch_date('ts')}) - 1 AS INTEGER) AS day_of_week",
            "CAST(((CAST(floor(ts / 3600) AS BIGINT) % 24) + 24) % 24 AS INTEGER) AS hour_of_day",
            f"{bin_sql('a_follower_count')} AS bin"]
    sel += [f"{has(c)} AS has_{t}" for t, c in zip(TARGETS, LABEL_COLS)]
    sel += ["coalesce(d.code, -10) AS language_encoding",
            f"{R(signed_log1p('(a_account_creation - b_account_creation)'))} AS a_b_creation_delta",
            f"{R(signed_log1p('(ts - a_account_creation)'))} AS a_creation_delta",
            f"{R(signed_log1p('(ts - b_account_creation)'))} AS b_creation_delta",
            f"{R(ratio('a_follower_count', 'b_follower_count'))} AS a_b_follower_ratio",
            f"{R(ratio('b_follower_count', 'a_follower_count'))} AS b_a_follower_ratio",
            f"{R(ratio('a_following_count', 'b_following_count'))} AS a_b_following_ratio",
            f"{R(ratio('b_following_count', 'a_following_count'))} AS b_a_following_ratio"]
    if noise:
        sel = sel[:2]
    for k, (side, al) in enumerate((("A", "ta"), ("B", "tb"))):
        for j, c in enumerate(te_names):
            added = f" + {noise} * {normal_sql(['v.tweet_id', 'v.b_user_id'], k * len(te_names) + j, 0)}" if noise else ""
            sel.append(R(f"coalesce({al}.{c}, -10.0){added}") + f" AS {c}_{side}")
    return (W + f", tr AS (SELECT * FROM interactions WHERE {train_pred()}),\n"
            f"idx AS ({user_index_sql('tr')}),\npr AS ({priors_sql('idx')}),\nte AS ({te_sql('idx', 'pr')}),\n"
            "d AS (SELECT language AS value, CAST(dense_rank() OVER (ORDER BY language) - 1 AS BIGINT) AS code "
            "FROM (SELECT DISTINCT language FROM interactions WHERE language IS NOT NULL) x),\n"
            f"v AS (SELECT * FROM interactions WHERE {rows or val_pred()})\n"
            f"SELECT {', '.join(sel)} FROM v LEFT JOIN d ON v.language = d.value "
            f"LEFT JOIN te ta ON ta.user_id = {uid('v.a_user_id')} LEFT JOIN te tb ON tb.user_id = {uid('v.b_user_id')}")


def _sql3() -> dict[str, str]:
    from ..schema import BIN_WEIGHTS, CLASS_WEIGHTS
    from ..sources.fixtures import INTERACTION_COLS
    q: dict[str, str] = {}
    q["training_table"] = _training_table_sql()
    fold = f"CAST(floor({unit_hash_sql(['tweet_id', 'b_user_id', 'ts'], 'fold')} * 5) AS INTEGER)"
    q["te_group_oof"] = _labelled_cte() + (
        f", r AS (SELECT *, {fold} AS fold, CAST(has_like AS DOUBLE) AS y FROM interactions),\n"
        "per AS (SELECT language, fold, count(*) AS n, sum(y) AS s FROM r GROUP BY 1, 2),\n"
        "tot AS (SELECT language, sum(n) AS nn, sum(s) AS ss FROM per GROUP BY 1),\n"
        "ft AS (SELECT fold, count(*) AS fn, sum(y) AS fs FROM r GROUP BY 1), allr AS (SELECT count(*) AS an, sum(y) AS als FROM r),\n"
        "pm AS (SELECT fold, (als - fs) / NULLIF(an - fn, 0) AS pm FROM ft CROSS JOIN allr),\n"
        "enc AS (SELECT per.language, per.fold, ((ss - s) + 20.0 * pm) / NULLIF((nn - n) + 20.0, 0) AS e "
        "FROM per JOIN tot USING (language) JOIN pm USING (fold))\n"
        f"SELECT {IDS}, language, {R('coalesce(e, -1.0)')} AS TE_language_like_oof FROM r LEFT JOIN enc USING (language, fold)")
    L = _labelled_cte()
    prior_m = "\nUNION ALL\n".join(
        f"SELECT {bin_sql('a_follower_count')} AS bin, '{t}' AS target, prior_{t} AS score, CAST(has_{t} AS INTEGER) AS y "
        f"FROM interactions CROSS JOIN pri WHERE {val_pred()}" for t in TARGETS)
    pri = ("SELECT " + ", ".join(f"avg(CAST(has_{t} AS DOUBLE)) AS prior_{t}" for t in TARGETS)
           + f" FROM interactions WHERE {train_pred()}")
    q["prior_baseline_metrics"] = L + (
        f", pri AS ({pri}), m AS ({prior_m}),\nr AS ({_rce_select(_rce_sql('bin, target'))}), a AS ({_ap_sql('bin, target')})\n"
        f"SELECT bin, target, n, {R('ctr')} AS ctr, {R('log_loss')} AS log_loss, {R('rce')} AS rce, {R('ap')} AS ap, positives "
        "FROM r FULL JOIN a USING (bin, target)")
    q["events_day_windows"] = ("SELECT user_id, CAST(floor(epoch(ts) / 86400) * 86400 AS BIGINT) AS day_start, "
                               "CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2")
    q["events_calendar"] = (f"SELECT event_type, CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week, CAST(hour(ts) AS INTEGER) AS hour_of_day, "
                            f"CAST(count(*) AS BIGINT) AS n, {R('sum(value)')} AS value_sum FROM events GROUP BY 1, 2, 3")
    q["documents_token_len"] = (f"SELECT doc_id, lang, {R('ln(1 + len(string_split(text, chr(32))))')} AS token_len_log, "
                                "CAST(length(text) AS BIGINT) AS n_chars FROM documents")
    lm = "\nUNION ALL\n".join(
        f"SELECT lang, '{t}' AS target, score, CAST({t} = 1 AS INTEGER) AS y FROM j" for t in ("quality", "toxic"))
    q["labels_metrics"] = (
        "WITH j AS (SELECT d.lang, round(1 / (1 + exp(5 - ln(1 + len(string_split(d.text, chr(32)))))), 3) AS score, l.quality, l.toxic "
        f"FROM documents d JOIN labels l ON d.doc_id = l.doc_id), m AS ({lm}),\n"
        f"r AS ({_rce_select(_rce_sql('lang, target'))}), a AS ({_ap_sql('lang, target')})\n"
        f"SELECT lang, target, n, {R('ctr')} AS ctr, {R('log_loss')} AS log_loss, {R('rce')} AS rce, {R('ap')} AS ap, positives "
        "FROM r FULL JOIN a USING (lang, target)")
    q["user_lookup"] = W + (
        ", top AS (SELECT b_user_id FROM interactions GROUP BY 1 ORDER BY count(*) DESC, b_user_id LIMIT 1)\n"
        f"SELECT {IDS}, type, {', '.join(LABEL_COLS)} FROM interactions WHERE b_user_id = (SELECT b_user_id FROM top)")
    q["head_preview"] = W + "SELECT ts, tweet_id, b_user_id, type FROM interactions ORDER BY ts, tweet_id, b_user_id, type LIMIT 10"
    q["batch_sizes"] = W + ("SELECT CAST(floor((rn - 1) / 5000) AS BIGINT) AS batch_id, CAST(count(*) AS BIGINT) AS n FROM "
                            "(SELECT row_number() OVER (ORDER BY ts, tweet_id, b_user_id, type) AS rn FROM interactions) x GROUP BY 1")
    combo = "array_to_string(string_split(coalesce(medias, ''), chr(9))[1:3], '_')"
    q["distinct_values"] = W + (
        "SELECT DISTINCT 'type' AS column_name, type AS value FROM interactions UNION ALL "
        "SELECT DISTINCT 'language', language FROM interactions UNION ALL "
        f"SELECT DISTINCT 'media_combo', {combo} FROM interactions")
    q["column_summary"] = W + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, CAST(count({c}) AS BIGINT) AS non_null FROM interactions" for c in INTERACTION_COLS)
    q["score_transforms"] = _labelled_cte(score=True) + (
        f"SELECT {IDS}, {R('exp(ln(abs(a_follower_count) + 1)) - 1')} AS followers_roundtrip, "
        f"{R('(score - 0.5) * 0.999 + 0.5')} AS squeezed, CAST(round_even(score, 0) AS INTEGER) AS decision, "
        "coalesce(reply_ts, 0) <> 0 AS nonzero_reply, "
        + R("coalesce(CASE WHEN b_following_count = 0 THEN CASE WHEN a_following_count <> 0 THEN 1e7 END "
            "ELSE CAST(a_following_count AS DOUBLE) / b_following_count END, 0.0)") + " AS ratio_or_zero FROM interactions")
    bw = "CASE bin " + " ".join(f"WHEN {b} THEN CAST({w!r} AS DOUBLE)" for b, w in BIN_WEIGHTS.items()) + " END"
    cw = {t: f"CASE WHEN has_{t} THEN CAST({CLASS_WEIGHTS[t][1]!r} AS DOUBLE) ELSE CAST({CLASS_WEIGHTS[t][0]!r} AS DOUBLE) END"
          for t in TARGETS}
    q["row_weights"] = L + (
        f", b AS (SELECT *, {bin_sql('a_follower_count')} AS bin FROM interactions WHERE {train_pred()})\n"
        f"SELECT {IDS}, bin, " + ", ".join(f"{R(f'({bw}) * ({cw[t]})')} AS w_{t}" for t in TARGETS) + " FROM b")
    users = lambda pred: (f"SELECT {uid('a_user_id')} AS user_id FROM interactions WHERE {pred} UNION "  # noqa: E731
                          f"SELECT {uid('b_user_id')} FROM interactions WHERE {pred}")
    q["index_diff"] = W + (
        f", tu AS ({users(train_pred())}), vu AS ({users(val_pred())})\n"
        "SELECT user_id, 'left_only' AS side FROM (SELECT user_id FROM tu EXCEPT SELECT user_id FROM vu) a UNION ALL "
        "SELECT user_id, 'right_only' FROM (SELECT user_id FROM vu EXCEPT SELECT user_id FROM tu) b UNION ALL "
        "SELECT user_id, 'both' FROM (SELECT user_id FROM tu INTERSECT SELECT user_id FROM vu) c")
    return q


def oracle_sql() -> dict[str, str]:
    out = _sql()
    out.update(_sql2())
    out["streaming_user_index"] = out["user_index"]
    out.update(_sql3())
    out["enriched_skew_split"] = out["enriched_interactions"]
    out.update(_roundtrips(out))
    return out
