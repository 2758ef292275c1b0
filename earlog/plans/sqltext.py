"""The derivations of `inputs` as SQL common table expressions, and a composer for queries."""
from __future__ import annotations

from earlog import config as C
from earlog.plans import inputs as I


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _pairs(names: list[str], first: int) -> str:
    return "[" + ", ".join(f"{{'name': {n}, 'score': round_even(u[{first + j}], 3)}}"
                           for j, n in enumerate(names)) + "]"


def _keep(entries: str, limit: float) -> str:
    return f"list_filter({entries}, lambda g: g.score >= {limit})"


_NONE = "CAST([] AS STRUCT(name VARCHAR, score DOUBLE)[])"
_GENRE = [f"{_list(I.GENRES)}[label + {k + 1}]" for k in range(5)]
_QUOTED = lambda names: ["'" + n + "'" for n in names]                              # noqa: E731

PARTS = {
    "listens": """SELECT event_id, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS track_id,
        ts AS listened_at FROM events WHERE event_type <> 'error'""",
    "plays": "SELECT l_partkey AS track_id, l_shipdate AS listened_at FROM lineitem",
    "uplays": """SELECT l_orderkey * 10 + l_linenumber AS event_id, o_custkey AS user_id, l_partkey AS track_id,
        l_shipdate AS listened_at FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "tracks": """SELECT p_partkey AS track_id, p_name AS title, p_brand AS channel,
        CASE WHEN p_size % 2 = 0 THEN '' ELSE p_brand END AS artist_canonical,
        CASE WHEN p_size % 5 <> 0 THEN p_size * 10.0::DOUBLE END AS duration,
        p_type <> 'ECONOMY' AS is_music,
        CASE WHEN p_size < 10 THEN 'topic-channel' WHEN p_size < 20 THEN 'official+lyrics'
             WHEN p_size < 30 THEN 'manual' WHEN p_size < 40 THEN 'no-signal' ELSE '' END AS music_reason,
        COALESCE(NULLIF(CASE WHEN p_size % 2 = 0 THEN '' ELSE p_brand END, ''), p_brand) AS artist FROM part""",
    "ctracks": """SELECT t.*, CAST(COALESCE(n, 0) AS BIGINT) AS play_count FROM tracks t LEFT JOIN
        (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_partkey = track_id""",
    "emb": """SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e,
        list_transform(embedding, lambda x: least(1.0::DOUBLE, abs(CAST(x AS DOUBLE)) * 4)) AS u FROM embeddings""",
    "tagged": f"""SELECT *, e[60] BETWEEN -0.2 AND 0.2 AS tags_ok,
        CASE WHEN e[60] > 0.2 THEN '' ELSE 'x' END AS tags FROM emb""",
    "feat0": f"""SELECT vec_id AS track_id, label, tags, tags_ok, e, u,
        CASE WHEN e[49] > 0.25 THEN 'meta' ELSE 'audio' END AS source,
        CASE WHEN e[50] > 0.25 THEN 1 WHEN e[51] > 0.15 THEN 5 ELSE 6 END AS feat_version,
        round_even(abs(e[1]) * 400 + 60, 1) AS tempo, least(1.0::DOUBLE, abs(e[2]) * 4 + 0.5) AS mode_conf,
        u[3] AS energy, u[4] AS danceability, u[5] AS acousticness, u[6] AS brightness,
        {_list(I.KEYS)}[label + 1] AS key,
        CASE WHEN label <> 3 THEN u[46] END AS percussive, CASE WHEN label <> 4 THEN e[47] END AS dynamics,
        CASE WHEN label <> 5 THEN -60 * u[48] END AS loudness,
        CASE WHEN label <> 1 THEN u[31] END AS vocal_ratio,
        CASE label % 3 WHEN 0 THEN true WHEN 1 THEN false END AS has_vocals,
        CASE WHEN tags_ok AND label <> 7 THEN {_keep(_pairs(_GENRE[:3], 32), 0.05)} ELSE {_NONE} END AS genres,
        CASE WHEN tags_ok AND label <> 6 THEN {_keep(_pairs(_GENRE, 32), 0.02)} ELSE {_NONE} END AS styles,
        CASE WHEN tags_ok THEN {_keep(_pairs(_QUOTED(I.INSTRUMENTS), 37), 0.3)} ELSE {_NONE} END AS instruments,
        CASE WHEN tags_ok THEN {_keep(_pairs(_QUOTED(I.MOODTAGS), 52), 0.3)} ELSE {_NONE} END AS moodtags,
        CASE WHEN tags_ok THEN round_even(u[31], 3) ELSE 0.0 END AS tag_vocal,
        TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(vec_id AS INTEGER)) AS analyzed_at,
        {', '.join(f"CASE WHEN tags_ok AND label <> 2 THEN round_even(u[{20 + j}], 3) ELSE 0.125 END AS {c}"
                   for j, c in enumerate(C.MOOD_COLS))} FROM tagged""",
    "features": "SELECT *, CASE WHEN len(styles) > 0 THEN styles ELSE genres END AS genre_vec FROM feat0",
    "lyrics": """SELECT doc_id AS track_id, text, COALESCE(lang, '') AS language, CASE WHEN COALESCE(text, '') = '' THEN 'none'
        WHEN source = 'src0' THEN 'whisper' ELSE 'lrclib' END AS source FROM documents""",
    "attempts": """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS track_id,
        CASE WHEN event_type = 'signup' THEN 'lyrics' ELSE 'audio' END AS stage,
        CASE WHEN event_type IN ('error', 'signup') THEN 'dl-error' ELSE 'ok' END AS status,
        CASE WHEN event_type NOT IN ('error', 'signup') THEN ''
             WHEN value < 5 THEN 'ERROR: Video unavailable. This video is private'
             WHEN value < 20 THEN 'Sign in to confirm you''re not a bot'
             WHEN value < 40 THEN 'HTTP Error 429: Too Many Requests'
             WHEN value < 60 THEN 'connection timed out' ELSE 'codec not supported' END AS error,
        ts AS tried_at FROM events""",
    "utracks": """SELECT p_partkey AS track_id,
        CASE p_type WHEN 'PROMO' THEN p_name || ' (Official Video)' WHEN 'ECONOMY' THEN p_name || ' gameplay review'
             WHEN 'SMALL' THEN p_brand || ' - ' || p_name WHEN 'LARGE' THEN p_name || ' [Audio] lyrics ft. someone'
             WHEN 'MEDIUM' THEN 'some one - ' || p_name ELSE p_name END AS title,
        CASE p_brand WHEN 'Brand#3' THEN p_brand || ' - Topic' WHEN 'Brand#4' THEN p_brand || 'VEVO'
             WHEN 'Brand#5' THEN p_brand || ' - Official' ELSE p_brand END AS channel,
        CASE WHEN p_size > 45 THEN true WHEN p_size > 40 THEN false END AS is_music,
        CASE WHEN p_size > 47 THEN 'manual' WHEN p_size > 45 THEN 'channel-music' WHEN p_size > 43
             THEN 'manual-not-music' WHEN p_size > 40 THEN 'anti-pattern' ELSE '' END AS music_reason FROM part""",
    "details": """SELECT p_partkey AS track_id, p_size * 3600.0 + (p_size + 1) * 60 + 5 AS duration,
        CASE WHEN p_size < 20 THEN 10 WHEN p_size < 30 THEN 24 END AS category_id, p_brand AS channel,
        p_name AS title FROM part WHERE p_size < 35""",
}

NEEDS = {"ctracks": ["tracks"], "tagged": ["emb"], "feat0": ["tagged"], "features": ["feat0"]}


def _closure(names) -> list[str]:
    out: list[str] = []
    for n in names:
        for m in _closure(NEEDS.get(n, [])) + [n]:
            if m not in out:
                out.append(m)
    return out


def compose(body: str, *needs: str) -> str:
    """Query text with the needed derivations in front; `body` may start with its own CTEs."""
    ctes = [f"{n} AS ({PARTS[n]})" for n in _closure(needs)]
    body = body.strip()
    if not ctes:
        return body
    for head in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(head):
            return head + ",\n".join(ctes) + ",\n" + body[len(head):]
    return "WITH " + ",\n".join(ctes) + "\n" + body

#: Latest outcome per item and stage; current errors are those that are not ok.
CURRENT = """cur AS (SELECT track_id, stage, status, error, tried_at AS created_at FROM attempts
    QUALIFY row_number() OVER (PARTITION BY track_id, stage ORDER BY tried_at DESC, event_id DESC) = 1)"""
