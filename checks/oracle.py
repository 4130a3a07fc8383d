"""The same results in SQL, one statement per registered query.

Written from the rules, not from the Spark plans: lines, islands and windows stand where the library
works on arrays inside a row, and a plain nested loop stands where it scores in blocks.
"""

from __future__ import annotations

from citeflow.functions.text import WHITESPACE
from citeflow.operators import prompts, rendering, sessions
from citeflow.operators.completion import APOLOGY

K = 10
BOT_USER = "0"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_WS = "||".join(f"chr({ord(c)})" for c in WHITESPACE)


def strip(x: str) -> str:
    return f"trim({x}, {_WS})"


TOKENS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"
FIRST_SENTENCE = r"(?s)^(.*?[.!?])(\s|$)"


def tokens(x: str) -> str:
    return TOKENS.format(x)


def query(select: str, *ctes: tuple[str, str]) -> str:
    if not ctes:
        return select
    return "WITH " + ",\n".join(f"{n} AS ({s})" for n, s in ctes) + "\n" + select


# --- inputs ----------------------------------------------------------------------------------

CORPUS = (
    "corpus",
    "SELECT doc_id AS chunk_id, text AS chunk, 'Document ' || doc_id AS document_title, "
    "'https://' || source || '.example.org/' || lang AS source_url FROM documents",
)
QUESTIONS = ("questions", "SELECT item_id AS qid, text AS question FROM benchmark")
QVECTORS = (
    "qv",
    "SELECT item_id AS qid, embedding::DOUBLE[] AS v FROM benchmark JOIN embeddings ON vec_id = item_id",
)
MESSAGES = (
    "messages",
    "SELECT conv_id, turn, role, text AS content FROM conversations WHERE role <> 'system'",
)
EVENTS = (
    "ev",
    """SELECT *, kind = 'message' AND bot_id IS NULL AND text IS NOT NULL AS accepted,
         kind IN ('clear', 'end') AS reset
       FROM (SELECT user_id AS channel, event_id, ts,
               CASE event_type WHEN 'purchase' THEN 'clear' WHEN 'signup' THEN 'end' ELSE 'message' END AS kind,
               CASE WHEN event_type = 'error' THEN props
                    WHEN event_type IN ('click', 'view') AND value >= 1 THEN props END AS text,
               CASE WHEN event_type = 'error' THEN 'b1' END AS bot_id,
               value >= 2 AS answered
             FROM events)""",
)
RESPONSES = (
    "responses",
    """SELECT rid AS response_id,
         '# Answer' || n || n || '**' || role || '** ' ||
         CASE WHEN rid % 5 = 4 THEN repeat(text || n || n, 120) || text ELSE text END ||
         ' [^1][^2]' || n || '- item one [^3]' || n || '- item two' || n || n || 'after list' || n ||
         '```sql' || n || 'select 1' || n || CASE WHEN rid % 5 = 2 THEN '' ELSE '```' || n END ||
         n || 'end.' || n ||
         CASE WHEN rid % 5 = 1 THEN '' ELSE
           n || 'Sources:' || n || '[^1] [Context document 1](https://a.example.org/' || m || ')' ||
           n || '[^2] [Context document 2](https://b.example.org/' || m || ')' ||
           n || '[^3] [Context document 3](https://a.example.org/' || m || ')' END ||
         CASE WHEN rid % 5 = 3 THEN n || 'Sources:' || n || '[^9] [Late](https://late.example.org/)'
              ELSE '' END AS response
       FROM (SELECT conv_id * 10 + turn AS rid, conv_id % 7 AS m, chr(10) AS n, role, text
             FROM conversations WHERE role = 'assistant')""",
)


# --- retrieval -------------------------------------------------------------------------------


def keyword(k: int, questions: str = "questions", text: str = "question") -> list[tuple[str, str]]:
    weight = (
        "ln(1 + (n - df + 0.5e0) / (df + 0.5e0)) * "
        "(tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * dl / (total / n))))"
    )
    return [
        ("tk", f"SELECT chunk_id, unnest({tokens('chunk')}) AS token FROM corpus"),
        ("tf", "SELECT chunk_id, token, count(*) AS tf FROM tk GROUP BY ALL"),
        ("dl", f"SELECT chunk_id, len({tokens('chunk')}) AS dl FROM corpus"),
        ("st", "SELECT count(*) AS n, sum(dl) AS total FROM dl"),
        ("df", "SELECT token, count(*) AS df FROM tf GROUP BY token"),
        ("qt", f"SELECT DISTINCT qid, unnest({tokens(text)}) AS token FROM {questions}"),
        (
            "ks",
            f"SELECT qid, chunk_id, sum(CAST({weight} AS DECIMAL(18,9))) AS s FROM qt "
            "JOIN tf USING (token) JOIN df USING (token) JOIN dl USING (chunk_id), st GROUP BY 1, 2",
        ),
        ("kw", ranked("ks", k)),
    ]


def ranked(scored: str, k: int) -> str:
    return (
        "SELECT qid, rank::INTEGER AS rank, s::DECIMAL(18,9) AS score, chunk_id FROM (SELECT *, "
        f"row_number() OVER (PARTITION BY qid ORDER BY s DESC, chunk_id) AS rank FROM {scored}) "
        f"WHERE rank <= {k}"
    )


def semantic(k: int, qvectors: tuple[str, str] = QVECTORS) -> list[tuple[str, str]]:
    return [
        qvectors,
        ("cv", "SELECT vec_id AS chunk_id, embedding::DOUBLE[] AS v FROM embeddings"),
        (
            "ss",
            "SELECT qid, chunk_id, CAST(list_dot_product(cv.v, qv.v) AS DECIMAL(18,9)) AS s FROM cv, qv",
        ),
        ("sem", ranked("ss", k)),
    ]


def dimension(token: str) -> str:
    digits = " + ".join(
        f"{16 ** (4 - i)} * (strpos('0123456789abcdef', substr(md5({token}), {i}, 1)) - 1)" for i in range(1, 5)
    )
    return f"(({digits}) % 512)"


# Weights of the dimensions that a text touches: counts by inverse document frequency, to unit length.
EMBEDDED = [
    ("ed", f"SELECT chunk_id, {dimension('token')} AS dim, count(*) AS tf FROM "
     f"(SELECT chunk_id, unnest({tokens('chunk')}) AS token FROM corpus) GROUP BY ALL"),
    ("ei", "SELECT dim, ln(((SELECT count(*) FROM corpus) + 1)::DOUBLE / (count(*) + 1)) AS idf FROM ed GROUP BY dim"),
    ("en", "SELECT chunk_id, sqrt(sum((tf * idf) ** 2)) AS norm FROM ed JOIN ei USING (dim) GROUP BY chunk_id"),
    ("ev", "SELECT chunk_id, dim, tf * idf / norm AS w FROM ed JOIN ei USING (dim) JOIN en USING (chunk_id) WHERE norm > 0"),
]


def semantic_text(k: int, questions: str = "questions", text: str = "question") -> list[tuple[str, str]]:
    idf = "coalesce(idf, ln((SELECT count(*) FROM corpus) + 1.0e0))"
    return [
        *EMBEDDED,
        ("qd", f"SELECT qid, {dimension('token')} AS dim, count(*) AS tf FROM "
         f"(SELECT qid, unnest({tokens(text)}) AS token FROM {questions}) GROUP BY ALL"),
        ("qi", f"SELECT qid, dim, tf * {idf} AS x FROM qd LEFT JOIN ei USING (dim)"),
        ("qn", "SELECT qid, sqrt(sum(x ** 2)) AS norm FROM qi GROUP BY qid"),
        ("qw", "SELECT qid, dim, x / norm AS w FROM qi JOIN qn USING (qid) WHERE norm > 0"),
        ("dots", "SELECT qid, chunk_id, sum(ev.w * qw.w) AS s FROM ev JOIN qw USING (dim) GROUP BY ALL"),
        ("ts", f"SELECT q.qid, c.chunk_id, CAST(coalesce(s, 0) AS DECIMAL(18,9)) AS s FROM {questions} q CROSS JOIN corpus c "
         "LEFT JOIN dots ON dots.qid = q.qid AND dots.chunk_id = c.chunk_id"),
        ("sem", ranked("ts", k)),
    ]


KW = [CORPUS, QUESTIONS, *keyword(K)]
SEM = [CORPUS, QUESTIONS, *semantic_text(K)]
STORED = semantic(K)
BOTH = [CORPUS, QUESTIONS, *keyword(K), *semantic_text(K)]
BOTH2 = [CORPUS, QUESTIONS, *keyword(2 * K), *semantic_text(2 * K)]
HIT = "qid, rank, round(score::DOUBLE, 6) AS score, chunk_id"
LEGS = (
    "legs",
    "SELECT *, 0::INTEGER AS leg FROM sem UNION ALL SELECT *, 1::INTEGER AS leg FROM kw",
)


def first_seen(k: int) -> list[tuple[str, str]]:
    return [
        LEGS,
        ("texts", "SELECT legs.*, chunk FROM legs JOIN corpus USING (chunk_id)"),
        (
            "firsts",
            "SELECT * FROM texts QUALIFY row_number() OVER (PARTITION BY qid, chunk ORDER BY leg, rank) = 1",
        ),
        (
            "merged",
            "SELECT qid, place::INTEGER AS rank, score, chunk_id, leg, chunk FROM (SELECT *, row_number() OVER "
            f"(PARTITION BY qid ORDER BY leg, rank) AS place FROM firsts) WHERE place <= {k}",
        ),
    ]


def boosted(k: int, normalize: bool) -> list[tuple[str, str]]:
    scale = "CASE WHEN top > 0 THEN CAST(score::DOUBLE / top::DOUBLE AS DECIMAL(18,9)) ELSE score END"
    return [
        LEGS,
        (
            "texts",
            f"SELECT qid, chunk_id, leg, rank, chunk, {scale if normalize else 'score'} AS score FROM "
            "(SELECT legs.*, chunk, max(score) OVER (PARTITION BY qid, leg) AS top "
            "FROM legs JOIN corpus USING (chunk_id))",
        ),
        (
            "s",
            "SELECT *, (score * 1.2::DECIMAL(2,1))::DECIMAL(21,10) AS b FROM texts WHERE leg = 0 "
            "QUALIFY row_number() OVER (PARTITION BY qid, chunk ORDER BY rank) = 1",
        ),
        (
            "kb",
            "SELECT *, score::DECIMAL(21,10) AS b, min(rank) OVER (PARTITION BY qid, chunk) AS first_rank "
            "FROM texts WHERE leg = 1 "
            "QUALIFY row_number() OVER (PARTITION BY qid, chunk ORDER BY score DESC, rank) = 1",
        ),
        (
            "picked",
            "SELECT coalesce(s.qid, kb.qid) AS qid, coalesce(s.chunk, kb.chunk) AS chunk, "
            "CASE WHEN s.qid IS NULL OR kb.b > s.b THEN kb.b ELSE s.b END AS score, "
            "CASE WHEN s.qid IS NULL OR kb.b > s.b THEN 1 ELSE 0 END::INTEGER AS leg, "
            "CASE WHEN s.qid IS NULL OR kb.b > s.b THEN kb.chunk_id ELSE s.chunk_id END AS chunk_id, "
            "coalesce(s.rank, 1000000 + kb.first_rank) AS place "
            "FROM s FULL JOIN kb ON s.qid = kb.qid AND s.chunk = kb.chunk",
        ),
        (
            "merged",
            "SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, place)::INTEGER AS rank, "
            f"score, chunk_id, leg, chunk FROM picked QUALIFY rank <= {k}",
        ),
    ]


# --- context ---------------------------------------------------------------------------------

FOUND = ("found", "SELECT kw.*, chunk, document_title, source_url FROM kw JOIN corpus USING (chunk_id)")


def context(rows: str, text: str, url: str = "source_url") -> str:
    line = f"'Context document ' || rank || ': ' || {text} || ' [URL: ' || {url} || ']' || chr(10) || chr(10)"
    return f"SELECT qid, string_agg({line}, '' ORDER BY rank) AS context FROM {rows} GROUP BY qid"


CITED = (
    "cited",
    "SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY rank)::INTEGER AS index, "
    "document_title AS title, source_url AS source FROM "
    "(SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY qid, source_url ORDER BY rank) = 1)",
)
CITED_JSON = (
    "cited_json",
    "SELECT qid, to_json(list({'index': index, 'title': title, 'source': source} ORDER BY index))::VARCHAR "
    "AS citations FROM cited GROUP BY qid",
)


def slot(tag: str, value: str) -> str:
    return f"'<{tag}>' || chr(10) || {value} || chr(10) || '</{tag}>'"


def prompt(rules: str, *slots: str) -> str:
    return " || chr(10) || ".join([lit("[INST]\n" + rules), *slots, "'[/INST]'"])


def extractive(rows: str) -> str:
    bare = strip("chunk")
    said = f"regexp_extract({bare}, '{FIRST_SENTENCE}', 1)"
    line = f"CASE WHEN {said} = '' THEN {bare} ELSE {said} END || ' [^' || rank || ']'"
    cited = "'[^' || rank || '] [Context document ' || rank || '](' || source_url || ')'"
    return (
        f"SELECT qid, string_agg({line}, chr(10) ORDER BY rank) || chr(10) || chr(10) || 'Sources:' || "
        f"chr(10) || string_agg({cited}, chr(10) ORDER BY rank) AS response FROM {rows} GROUP BY qid"
    )


BOT_PROMPT = prompt(
    prompts._BOT_RULES, slot("context", "context"), slot("citation", "citations"), slot("question", "question")
)

# --- history ---------------------------------------------------------------------------------


def window(n: int) -> tuple[str, str]:
    return (
        "win",
        "SELECT conv_id, turn, role, content FROM (SELECT *, row_number() OVER "
        f"(PARTITION BY conv_id ORDER BY turn DESC) AS age FROM messages) WHERE age BETWEEN 2 AND {n}",
    )


def cleaned(x: str) -> str:
    return strip(rf"string_split(regexp_replace({x}, '\[\^[0-9]+\]', '', 'g'), 'Sources:')[1]")


RENDERED = (
    "rendered",
    f"SELECT conv_id, string_agg(role || ': ' || {cleaned('content')}, chr(10) ORDER BY turn) AS history_text, "
    "to_json(list({'role': role, 'content': content} ORDER BY turn))::VARCHAR AS history_json "
    "FROM win GROUP BY conv_id",
)
WEB_QUESTIONS = (
    "web_questions",
    "SELECT conv_id AS qid, replace(arg_max(content, turn), '''', '') AS question FROM messages GROUP BY conv_id",
)
TOLD = [
    MESSAGES,
    window(4),
    RENDERED,
    WEB_QUESTIONS,
    (
        "told",
        "SELECT qid, question, history_text, history_json FROM web_questions LEFT JOIN rendered ON conv_id = qid",
    ),
]
REWRITE_PROMPT = prompt(
    prompts._REWRITE_RULES, slot("chat_history", "coalesce(history_text, '')"), slot("question", "question")
)

# --- responses -------------------------------------------------------------------------------

PARTS = (
    "parts",
    "SELECT response_id, response, string_split(response, 'Sources:')[1] AS raw_body, "
    "coalesce(string_split(response, 'Sources:')[2], '') AS raw_sources FROM responses",
)
SPLIT = (
    "split",
    f"SELECT response_id, {strip('raw_body')} AS body, {strip('raw_sources')} AS sources FROM parts",
)


def numbered(rows: str, text: str) -> str:
    return (
        f"SELECT response_id, generate_subscripts(a, 1) AS i, unnest(a) AS v FROM "
        f"(SELECT response_id, string_split({text}, chr(10)) AS a FROM {rows})"
    )


LINK = r"\[(.*?)\]\((https?://[^)]+)\)"
ENTRIES = [
    ("sl", numbered("split", "sources")),
    (
        "entries",
        rf"SELECT response_id, i::INTEGER AS pos, regexp_extract(v, '\[\^(\d+)\]', 1) AS num, "
        f"{strip(f'regexp_extract(v, {lit(LINK)}, 1)')} AS title, "
        f"{strip(f'regexp_extract(v, {lit(LINK)}, 2)')} AS url FROM sl "
        rf"WHERE regexp_matches(v, '\[\^\d+\]') AND regexp_matches(v, {lit(LINK)})",
    ),
]
GROUPS = [
    (
        "grouped",
        "SELECT response_id, url, min(pos) AS first_pos, arg_min(title, pos) AS title, "
        "string_agg(num, ',' ORDER BY pos) AS nums FROM entries GROUP BY response_id, url",
    ),
    (
        "groups",
        "SELECT response_id, row_number() OVER w::INTEGER AS pos, url, title, "
        "coalesce(['①','②','③','④','⑤','⑥','⑦','⑧','⑨','⑩'][row_number() OVER w], '•') AS symbol, nums "
        "FROM grouped WINDOW w AS (PARTITION BY response_id ORDER BY first_pos)",
    ),
]


def _replaced() -> str:
    text = "body"
    for n in (1, 2, 3):
        text = f"replace({text}, '[^{n}]', coalesce(' ' || s{n} || ' ', '[^{n}]'))"
    return text


SYMBOLS = [
    (
        "marks",
        "SELECT e.response_id, num, arg_max(symbol, g.pos) AS symbol FROM entries e "
        "JOIN groups g USING (response_id, url) GROUP BY ALL",
    ),
    (
        "pivoted",
        "SELECT response_id, " + ", ".join(f"max(symbol) FILTER (num = '{n}') AS s{n}" for n in (1, 2, 3))
        + " FROM marks GROUP BY response_id",
    ),
    ("symbols", f"SELECT response_id, {_replaced()} AS text FROM split LEFT JOIN pivoted USING (response_id)"),
]
CHAT = (
    "chat",
    r"SELECT response_id, regexp_replace(regexp_replace(text, '\*\*(.*?)\*\*', '*\1*', 'g'), "
    r"'(?m)^\s*#+\s*(.*)', chr(10) || '*\1*' || chr(10), 'g') AS text FROM symbols",
)
CITING = [RESPONSES, PARTS, SPLIT, *ENTRIES, *GROUPS]
CHATTING = [*CITING, *SYMBOLS, CHAT]
SEGMENTS = [
    ("bl", numbered("chat", "text")),
    ("bf", f"SELECT *, starts_with({strip('v')}, '```') AS fence, {strip('v')} = '' AS blank FROM bl"),
    (
        "bn",
        "SELECT *, sum(fence::INT) OVER w AS fno, "
        "coalesce(sum((fence OR blank)::INT) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS island, "
        "sum(fence::INT) OVER (PARTITION BY response_id) AS fences, max(i) OVER (PARTITION BY response_id) AS last_i "
        "FROM bf WINDOW w AS (PARTITION BY response_id ORDER BY i)",
    ),
    (
        "codes",
        f"SELECT o.response_id, o.i AS line_no, '```' || chr(10) || replace({strip('o.v')}, '```', '') || chr(10) || "
        "coalesce(string_agg(c.v, chr(10) ORDER BY c.i), '') || chr(10) || '```' AS text "
        "FROM bn o LEFT JOIN bn c ON c.response_id = o.response_id AND c.fno = o.fno AND NOT c.fence "
        "WHERE o.fence AND o.fno % 2 = 1 AND o.fno < o.fences GROUP BY o.response_id, o.i, o.v",
    ),
    (
        "runs",
        f"SELECT response_id, min(i) AS line_no, {strip('string_agg(v, chr(10) ORDER BY i)')} || "
        "CASE WHEN max(i) = any_value(last_i) THEN chr(10) ELSE '' END AS text "
        "FROM bn WHERE fno % 2 = 0 AND NOT fence AND NOT blank GROUP BY response_id, island",
    ),
    (
        "segments",
        "SELECT response_id, row_number() OVER (PARTITION BY response_id ORDER BY line_no)::INTEGER AS block_no, "
        "'section' AS type, text FROM (SELECT * FROM codes UNION ALL SELECT * FROM runs)",
    ),
]
BLOCKS = [
    ("counts", "SELECT response_id, max(block_no) AS n FROM segments GROUP BY response_id"),
    (
        "refs",
        "SELECT response_id, " + strip(
            "'*References*' || chr(10) || string_agg(' ' || symbol || ' <' || url || '|' || title || '>' || chr(10), '' ORDER BY pos)"
        ) + " || chr(10) AS text FROM groups GROUP BY response_id",
    ),
    (
        "blocks",
        "SELECT * FROM segments UNION ALL "
        "SELECT response_id, (coalesce(n, 0) + 1)::INTEGER, 'divider', NULL FROM refs LEFT JOIN counts USING (response_id) UNION ALL "
        "SELECT response_id, (coalesce(n, 0) + 2)::INTEGER, 'section', text FROM refs LEFT JOIN counts USING (response_id)",
    ),
]
PAGES = (
    "pgs",
    "SELECT response_id, ((block_no - 1) // 50)::INTEGER AS page_no, "
    + strip(
        "string_agg(CASE type WHEN 'section' THEN text || chr(10) || chr(10) ELSE '---' || chr(10) END, '' ORDER BY block_no)"
    )
    + " AS fallback_text, count(*)::INTEGER AS n_blocks FROM blocks GROUP BY 1, 2",
)
RENDERING = [*CHATTING, *SEGMENTS, *BLOCKS, PAGES]
SPACED = [
    ("ll", numbered("split", "body")),
    ("lf", f"SELECT response_id, i, {strip('v')} AS v FROM ll WHERE {strip('v')} <> ''"),
    (
        "lg",
        "SELECT *, lag(isl, 1, false) OVER (PARTITION BY response_id ORDER BY i) AS was FROM "
        "(SELECT *, starts_with(v, '- ') OR starts_with(v, '* ') AS isl FROM lf)",
    ),
    (
        "spaced",
        "SELECT response_id, string_agg(CASE WHEN isl <> was THEN chr(10) || v ELSE v END, chr(10) ORDER BY i) AS t "
        "FROM lg GROUP BY response_id",
    ),
    (
        "formatted",
        "SELECT response_id, coalesce(t, '') || CASE WHEN sources <> '' THEN chr(10) || chr(10) || '**Sources:**' "
        "|| chr(10) || sources ELSE '' END AS formatted FROM split LEFT JOIN spaced USING (response_id)",
    ),
]
DISPLAY = (
    "SELECT response_id, replace(replace(raw_body, '[^', '<sup>'), ']', '</sup>') || "
    "CASE WHEN raw_sources <> '' THEN chr(10) || 'Sources:' || raw_sources ELSE '' END AS display FROM parts"
)

# --- sessions --------------------------------------------------------------------------------

STATE = (
    "state",
    """SELECT *, row_number() OVER w AS rn,
         coalesce(sum(accepted::INT) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0 AS known,
         sum(reset::INT) OVER w AS epoch, sum(accepted::INT) OVER w AS nth
       FROM ev WHERE accepted OR reset WINDOW w AS (PARTITION BY channel ORDER BY ts, event_id)""",
)
HISTORY_LEN = (
    "SELECT channel, event_id, kind, epoch::BIGINT AS epoch, "
    "(2 * sum((accepted AND answered)::INT) OVER (PARTITION BY channel, epoch ORDER BY ts, event_id))::BIGINT AS history_len "
    "FROM state"
)
FIRST_CONTACT = "SELECT channel, event_id FROM state WHERE accepted AND nth = 1"
CLEAR = (
    f"SELECT channel, event_id, known, CASE WHEN known THEN {lit(sessions.CLEARED)} "
    f"ELSE {lit(sessions.NOTHING_TO_CLEAR)} END AS notice FROM state WHERE kind = 'clear'"
)
END = f"SELECT channel, event_id, known, {lit(sessions.ENDED)} AS notice FROM state WHERE kind = 'end'"


# Each message with the first end event of its channel after it, found by looking at the ends themselves.
DELETED = (
    "SELECT m.channel, m.event_id, m.ts, m.bot_id, arg_min(e.event_id, (e.ts, e.event_id)) AS end_event_id "
    "FROM ev m JOIN ev e ON e.channel = m.channel AND e.kind = 'end' AND (e.ts, e.event_id) > (m.ts, m.event_id) "
    "WHERE m.kind = 'message' GROUP BY ALL"
)


def paged(keys: str) -> str:
    return f"((row_number() OVER (PARTITION BY {keys} ORDER BY ts DESC, event_id DESC) - 1) // 100)::INTEGER AS page_no"


# --- whole plans -----------------------------------------------------------------------------

WEB = [
    *TOLD,
    (
        "routed",
        "SELECT qid, question, coalesce(history_json, '[]') AS chat_history, CASE WHEN history_json IS NULL THEN question "
        + "ELSE " + strip(r"question || ' ' || regexp_replace(history_text, '\s+', ' ', 'g')") + " END AS search_query FROM told",
    ),
    CORPUS,
    *keyword(K, "routed", "search_query"),
    *semantic_text(K, "routed", "search_query"),
    *first_seen(K),
    ("shown", "SELECT merged.*, source_url FROM merged JOIN corpus USING (chunk_id)"),
    ("ctx", context("shown", strip("chunk"))),
    ("answers", extractive("(SELECT * REPLACE (" + strip("chunk") + " AS chunk) FROM shown)")),
    (
        "responses",
        f"SELECT qid AS response_id, coalesce(response, {lit(prompts.REFUSAL)}) AS response FROM routed LEFT JOIN answers USING (qid)",
    ),
    PARTS,
    SPLIT,
    *SPACED,
    ("displays", DISPLAY),
]
BOT = [
    CORPUS,
    ("questions", f"SELECT item_id AS qid, {strip('lower(text)')} AS question FROM benchmark"),
    *keyword(K),
    FOUND,
    CITED,
    CITED_JSON,
    ("ctx", context("found", "chunk")),
    ("answers", extractive("found")),
    (
        "told",
        "SELECT qid, question, coalesce(context, '') AS context, coalesce(citations, '[]') AS citations, "
        f"coalesce(response, {lit(prompts.REFUSAL)}) AS response FROM questions LEFT JOIN ctx USING (qid) "
        "LEFT JOIN cited_json USING (qid) LEFT JOIN answers USING (qid)",
    ),
]
BOT_DEFAULT = [
    CORPUS,
    ("questions", f"SELECT item_id AS qid, {strip('lower(text)')} AS question FROM benchmark"),
    *semantic_text(K),
    ("kw", "SELECT * FROM sem"),
    FOUND,
    CITED,
    CITED_JSON,
    ("ctx", context("found", "chunk")),
    ("answers", extractive("found")),
    (
        "told",
        "SELECT qid, question, coalesce(context, '') AS context, coalesce(citations, '[]') AS citations, "
        f"coalesce(response, {lit(prompts.REFUSAL)}) AS response FROM questions LEFT JOIN ctx USING (qid) "
        "LEFT JOIN cited_json USING (qid) LEFT JOIN answers USING (qid)",
    ),
]

LINES = (
    "lines",
    "SELECT doc_id, source, generate_subscripts(a, 1)::INTEGER AS index, unnest(a) AS value FROM "
    "(SELECT doc_id, source, string_split(text, chr(10)) AS a FROM documents)",
)


def unescaped(x: str) -> str:
    for mark, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        x = f"replace({x}, {lit(mark)}, {lit(char)})"
    return x


HIDDEN = r"(?is)<head\b.*?</head>|<script\b.*?</script>|<style\b.*?</style>|<nav\b.*?</nav>|<!--.*?-->"
NO_TAGS = f"regexp_replace(regexp_replace(html, '{HIDDEN}', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"
PAGES_CORPUS = (
    "SELECT page_id AS chunk_id, "
    + strip(f"regexp_replace({unescaped(NO_TAGS)}, '\\s+', ' ', 'g')")
    + " AS chunk, "
    + strip(unescaped("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"))
    + " AS document_title, url AS source_url FROM pages"
)
PAIRED = (
    "paired",
    "SELECT u.conv_id, u.turn, u.text AS question, a.text AS response FROM conversations u LEFT JOIN conversations a "
    "ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'",
)

STORED_HISTORY = query(
    "SELECT channel, (2 * i + p)::INTEGER AS position, role, content FROM (SELECT channel, i, p, role, CASE p WHEN 0 THEN "
    + strip("lower(text)")
    + " ELSE 're: ' || props END AS content FROM held, (VALUES (0, 'user'), (1, 'assistant')) r(p, role))",
    EVENTS,
    STATE,
    ("latest", "SELECT channel AS c, max(epoch) AS e FROM state GROUP BY channel"),
    (
        "held",
        "SELECT state.channel, text, text AS props, row_number() OVER (PARTITION BY state.channel ORDER BY ts, event_id) - 1 AS i "
        "FROM state JOIN latest ON c = channel AND e = epoch WHERE accepted AND answered",
    ),
)

ORACLE_SQL = {
    "corpus_catalog": query(
        "SELECT 'docs' AS name, 'chunk' AS search_column, count(*) AS chunks, sum(length(chunk))::BIGINT AS chars FROM corpus "
        "UNION ALL SELECT 'pages_corpus', 'chunk', count(*), sum(length(chunk))::BIGINT FROM page_corpus",
        CORPUS,
        ("page_corpus", PAGES_CORPUS),
    ),
    "corpus_select": query("SELECT * FROM corpus", CORPUS),
    "search_projection": query(f"SELECT {HIT}, document_title, source_url FROM found", *KW, FOUND),
    "content_fallback": (
        "SELECT 'null_chunk' AS case_name, doc_id, CASE WHEN doc_id % 3 <> 0 THEN text ELSE "
        + lit("Content not found - available keys: ['doc_id', 'chunk', 'content']")
        + " END AS content FROM documents UNION ALL SELECT 'upper', doc_id, text FROM documents UNION ALL "
        "SELECT 'none', doc_id, " + lit("Content not found - available keys: ['doc_id', 'lang']") + " FROM documents"
    ),
    "log_tail": query(
        "SELECT doc_id, index, value FROM lines WHERE trim(value, ' ') <> '' "
        "QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY index DESC) <= 300",
        LINES,
    ),
    "log_tail_by_source": query(
        "SELECT source, doc_id, index, value, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC, index DESC)"
        "::INTEGER AS tail_rank FROM lines WHERE trim(value, ' ') <> '' QUALIFY tail_rank <= 300",
        LINES,
    ),
    "log_file_tail": (
        "SELECT log, row_number() OVER (PARTITION BY log ORDER BY doc_id DESC, i DESC)::INTEGER AS from_end, value FROM ("
        "SELECT source || '-' || (doc_id // 1000) AS log, doc_id, unnest(range(len(l))) AS i, unnest(l) AS value "
        "FROM (SELECT source, doc_id, string_split(text, chr(10)) AS l FROM documents)) "
        "WHERE trim(value) <> '' QUALIFY from_end <= 300"
    ),
    "log_tail_overall": query(
        "SELECT doc_id, index, value FROM lines WHERE trim(value, ' ') <> '' ORDER BY doc_id DESC, index DESC LIMIT 300",
        LINES,
    ),
    "piped_query": "SELECT 'EVENTS' AS description, event_type, count(*) AS n FROM events GROUP BY event_type",
    "like_filter_concat": "SELECT concat('open ', url) AS command FROM pages WHERE url LIKE 'http://%'",
    "result_scan": "SELECT source, count(*) AS n FROM documents WHERE lang = 'en' GROUP BY source",
    "bound_parameters": (
        "SELECT conv_id, turn, 'it''s' AS model, text || ' -- ?' AS prompt FROM conversations WHERE role = 'user'"
    ),
    "transcript_append": query(
        "SELECT conv_id, turn, part::INTEGER AS part, role, CASE part WHEN 1 THEN question ELSE response END AS content, "
        "batch_id::BIGINT AS batch_id FROM paired, (VALUES (1, 'user'), (2, 'assistant')) p(part, role), "
        "(VALUES (0), (1)) b(batch_id) WHERE batch_id = 0 OR coalesce(response, '') <> ''",
        PAIRED,
    ),
    "corpus_from_pages": PAGES_CORPUS,
    "chunk_documents": query(
        "SELECT doc_id, (s // 160 + 1)::INTEGER AS chunk_no, len(w[s + 1:s + 200])::INTEGER AS n_words, "
        "array_to_string(w[s + 1:s + 200], ' ') AS chunk FROM "
        "(SELECT doc_id, w, unnest(range(0, greatest(len(w) - 40, 1), 160)) AS s FROM words)",
        (
            "words",
            "SELECT doc_id, string_split(t, ' ') AS w FROM (SELECT doc_id, "
            + strip(r"regexp_replace(text, '\s+', ' ', 'g')")
            + " AS t FROM documents) WHERE t <> ''",
        ),
    ),
    "keyword_search": query(f"SELECT {HIT} FROM kw", *KW),
    "keyword_search_indexed": query(f"SELECT {HIT} FROM kw", *KW),
    "keyword_search_segments": query(f"SELECT {HIT} FROM kw", *KW),
    "semantic_search": query(f"SELECT {HIT} FROM sem", *SEM),
    "default_search": query(f"SELECT {HIT} FROM sem", *SEM),
    "hybrid_first_seen": query(f"SELECT {HIT}, leg, chunk FROM merged", *BOTH, *first_seen(K)),
    "hybrid_boosted": query(f"SELECT {HIT}, leg, chunk FROM merged", *BOTH2, *boosted(K, True)),
    "hybrid_boosted_raw": query(f"SELECT {HIT}, leg, chunk FROM merged", *BOTH2, *boosted(K, False)),
    "dedupe_by_text": (
        "SELECT lang AS qid, doc_id AS rank, text AS chunk FROM documents "
        "QUALIFY row_number() OVER (PARTITION BY lang, text ORDER BY doc_id) = 1"
    ),
    "top_k_per_query": (
        "SELECT user_id AS qid, event_id, value AS score, "
        "row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id)::INTEGER AS rank "
        f"FROM events QUALIFY rank <= {K}"
    ),
    "union_all_ranked": query(
        "SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY leg, rank)::INTEGER AS rank, "
        "round(score::DOUBLE, 6) AS score, chunk_id, leg FROM legs",
        *BOTH,
        LEGS,
    ),
    "postings": query(
        "SELECT chunk_id, dl::INTEGER AS length, token, tf::INTEGER AS tf FROM tf JOIN dl USING (chunk_id)", *KW
    ),
    "term_stats": query("SELECT token, count(*) AS df, sum(tf)::BIGINT AS cf FROM tf GROUP BY token", *KW),
    "corpus_stats": query(
        "SELECT n AS n_docs, total::BIGINT AS total_length, round(total / n, 6) AS mean_length FROM st", *KW
    ),
    "context_web": query(context("found", strip("chunk")), *KW, FOUND),
    "context_bot": query(context("found", "chunk"), *KW, FOUND),
    "citations_by_url": query("SELECT qid, index, title, source FROM cited", *KW, FOUND, CITED),
    "url_default": query(
        "SELECT chunk_id, CASE WHEN chunk_id % 4 < 2 THEN '#' ELSE source_url END AS url FROM corpus", CORPUS
    ),
    "history_window": query("SELECT * FROM win", MESSAGES, window(4)),
    "history_window_recent": query("SELECT * FROM win", MESSAGES, window(4)),
    "strip_citations": (
        "SELECT conv_id, turn, "
        + cleaned(
            "('  ' || text || ' [^1][^12] ' || chr(10) || CASE WHEN turn % 2 = 0 THEN chr(10) || 'Sources: [^1] x' ELSE '' END)"
        )
        + " AS content FROM conversations"
    ),
    "history_render": query(
        "SELECT conv_id, history_text FROM rendered", MESSAGES, window(4), RENDERED
    ),
    "query_route": query(
        "SELECT true AS use_history, qid, CASE WHEN history_json IS NULL THEN question ELSE 'rewritten: ' || question END "
        "AS search_query, coalesce(history_json, '[]') AS chat_history FROM told UNION ALL "
        "SELECT false, qid, question, '' FROM told",
        *TOLD,
    ),
    "query_rewrite_prompt": query(f"SELECT qid, {REWRITE_PROMPT} AS prompt FROM told", *TOLD),
    "question_normalize": (
        "SELECT conv_id, turn, '  Its ' || replace(text, '''', '') || ' ' || chr(10) AS web, "
        + strip("lower('  It''s ' || text || ' ' || chr(10))")
        + " AS bot FROM conversations"
    ),
    "prompt_web": query(
        "SELECT qid, "
        + prompt(prompts._WEB_RULES, slot("chat_history", "'[]'"), slot("context", "context"), slot("question", "question"))
        + " AS prompt FROM questions JOIN ctx USING (qid)",
        *KW,
        FOUND,
        ("ctx", context("found", strip("chunk"))),
    ),
    "prompt_bot": query(
        f"SELECT qid, {BOT_PROMPT} AS prompt FROM questions JOIN ctx USING (qid) JOIN cited_json USING (qid)",
        *KW,
        FOUND,
        CITED,
        CITED_JSON,
        ("ctx", context("found", "chunk")),
    ),
    "complete": query(extractive("found"), *KW, FOUND),
    "model_select": (
        "SELECT conv_id, turn, CASE conv_id % 2 WHEN 0 THEN 'extractive' ELSE 'gpt-4.1' END AS model FROM conversations"
    ),
    "response_or_apology": query(
        f"SELECT response_id, CASE WHEN response_id % 4 > 1 THEN response ELSE {lit(APOLOGY)} END AS shown, "
        "response_id % 4 > 1 AS stored FROM responses",
        RESPONSES,
    ),
    "sources_split": query(
        "SELECT response_id, raw_body AS body, raw_sources AS sources FROM parts", RESPONSES, PARTS
    ),
    "list_spacing": query("SELECT * FROM formatted", RESPONSES, PARTS, SPLIT, *SPACED),
    "citation_superscript": query(DISPLAY, RESPONSES, PARTS),
    "source_line_parse": query("SELECT response_id, pos, num, title, url FROM entries", *CITING),
    "citation_groups": query("SELECT response_id, pos, url, title, symbol, nums FROM groups", *CITING),
    "citation_symbols": query("SELECT * FROM symbols", *CITING, *SYMBOLS),
    "markdown_to_mrkdwn": query("SELECT * FROM chat", *CHATTING),
    "block_segment": query("SELECT * FROM segments", *CHATTING, *SEGMENTS),
    "references_block": query("SELECT * FROM blocks", *RENDERING),
    "paginate_blocks": query("SELECT response_id, page_no, n_blocks FROM pgs", *RENDERING),
    "fallback_text": query("SELECT response_id, page_no, fallback_text FROM pgs", *RENDERING),
    "format_failure_fallback": query(
        "SELECT response_id, page_no, fallback_text FROM pgs WHERE response_id % 11 <> 0 UNION ALL "
        f"SELECT response_id, 0, {lit(rendering.FORMAT_NOTICE)} || response FROM responses WHERE response_id % 11 = 0",
        *RENDERING,
    ),
    "message_filter": query("SELECT channel, event_id, text FROM ev WHERE accepted", EVENTS),
    "channel_history_state": query(HISTORY_LEN, EVENTS, STATE),
    "channel_history_state_batch": query(HISTORY_LEN, EVENTS, STATE),
    "channel_history_state_split": query(HISTORY_LEN, EVENTS, STATE),
    "stored_history": STORED_HISTORY,
    "stored_history_split": STORED_HISTORY,
    "first_contact": query(FIRST_CONTACT, EVENTS, STATE),
    "first_contact_batch": query(FIRST_CONTACT, EVENTS, STATE),
    "clear_history": query(CLEAR, EVENTS, STATE),
    "clear_history_batch": query(CLEAR, EVENTS, STATE),
    "end_session": query(END, EVENTS, STATE),
    "end_session_batch": query(END, EVENTS, STATE),
    "self_join_filter": (
        f"SELECT user_id AS channel, event_id, '{BOT_USER}' AS user FROM events "
        "WHERE event_type = 'signup' AND user_id % 7 = 0"
    ),
    "active_channels": query("SELECT DISTINCT channel FROM ev WHERE accepted", EVENTS),
    "deletion_plan": query(
        f"SELECT channel, end_event_id, event_id, {paged('end_event_id')}, "
        "CASE WHEN bot_id IS NULL THEN 'user' ELSE 'bot' END AS credential FROM gone",
        EVENTS,
        ("gone", DELETED),
    ),
    "deletion_ledger": query(
        "SELECT channel, end_event_id, event_id, page_no, credential, NOT (wave = 0 AND broken) AS deleted, wave FROM "
        "(SELECT *, channel % 5 = 0 AND page_no = 1 AS broken FROM planned), (VALUES (0), (1)) w(wave) WHERE wave = 0 OR broken",
        EVENTS,
        ("gone", DELETED),
        (
            "planned",
            f"SELECT channel, end_event_id, event_id, {paged('end_event_id')}, "
            "CASE WHEN bot_id IS NULL THEN 'user' ELSE 'bot' END AS credential FROM gone",
        ),
    ),
    "live_messages": query(
        "SELECT channel, event_id FROM ev WHERE kind = 'message' AND event_id NOT IN (SELECT event_id FROM gone)",
        EVENTS,
        ("gone", DELETED),
    ),
    "purge_all": query(
        f"SELECT channel, event_id, {paged('channel')}, 'bot' AS credential FROM ev WHERE kind = 'message' "
        "AND channel IN (SELECT channel FROM ev WHERE accepted) AND event_id NOT IN (SELECT event_id FROM gone)",
        EVENTS,
        ("gone", DELETED),
    ),
    "purge_resets": query(
        "SELECT channel, arg_max(history_len, rn) AS entries FROM (SELECT *, "
        "(2 * sum((accepted AND answered)::INT) OVER (PARTITION BY channel, epoch ORDER BY ts, event_id))::BIGINT AS history_len "
        "FROM state) GROUP BY channel HAVING arg_max(history_len, rn) > 0",
        EVENTS,
        STATE,
    ),
    "answer_web": query(
        "SELECT qid, question, chat_history, search_query, coalesce(context, '') AS context, response, formatted, display "
        "FROM routed LEFT JOIN ctx USING (qid) JOIN responses ON responses.response_id = qid "
        "JOIN formatted ON formatted.response_id = qid JOIN displays ON displays.response_id = qid",
        *WEB,
    ),
    "answer_bot": query("SELECT *, response AS shown FROM told", *BOT),
    "answer_bot_indexed": query("SELECT *, response AS shown FROM told", *BOT),
    "answer_bot_fallback": query("SELECT *, response AS shown FROM told", *BOT),
    "answer_bot_default": query("SELECT *, response AS shown FROM told", *BOT_DEFAULT),
    "semantic_text_search": query(f"SELECT {HIT} FROM sem", *SEM),
    "semantic_search_ann": query(f"SELECT {HIT} FROM sem", *STORED),
    "semantic_search_stored": query(f"SELECT {HIT} FROM sem", *STORED),
    "embed_text": query(
        "SELECT chunk_id, dim::INTEGER AS dim, round(w, 6) AS weight FROM ev WHERE round(w, 6) <> 0",
        CORPUS,
        *EMBEDDED,
    ),
    "answer_bot_pages": query(
        "SELECT response_id, page_no, fallback_text FROM pgs",
        *BOT,
        ("responses", "SELECT qid AS response_id, response FROM told"),
        PARTS,
        SPLIT,
        *ENTRIES,
        *GROUPS,
        (
            "symbols",
            "SELECT response_id, list_reduce(list_prepend(body, list(' ' || symbol || ' ' ORDER BY num::INT)), "
            "lambda t, s, i: replace(t, '[^' || (i - 1) || ']', s)) AS text FROM split JOIN "
            "(SELECT e.response_id, num, arg_max(symbol, g.pos) AS symbol FROM entries e "
            "JOIN groups g USING (response_id, url) GROUP BY ALL) USING (response_id) GROUP BY response_id, body",
        ),
        CHAT,
        *SEGMENTS,
        *BLOCKS,
        PAGES,
    ),
    "answer_stream": query(
        "SELECT qid // 10 AS conv_id, qid AS turn, role, CASE role WHEN 'user' THEN question ELSE response END AS content "
        "FROM told, (VALUES ('user'), ('assistant')) r(role)",
        CORPUS,
        (
            "questions",
            f"SELECT conv_id * 10 + turn AS qid, {strip('lower(text)')} AS question FROM conversations WHERE role = 'user'",
        ),
        *keyword(K),
        FOUND,
        ("answers", extractive("found")),
        (
            "told",
            f"SELECT qid, question, coalesce(response, {lit(prompts.REFUSAL)}) AS response FROM questions "
            "LEFT JOIN answers USING (qid)",
        ),
    ),
}
