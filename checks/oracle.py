"""The DuckDB counterpart of every query in the catalogue that SQL can express."""

from __future__ import annotations

from checks.fixture import PLANS_DUCKDB, WIRE_DUCKDB, statement_log_duckdb
from stmtflow.operators.census import FUNCTIONS, KEYWORDS, MEASURES, PLAN_NODES, SUMMARY_LINES
from stmtflow.operators.ci import REPORT_TITLE
from stmtflow.operators.export import TITLE
from stmtflow.schema import OP_NAMES

ORACLES: dict[str, str] = {}


def q(text: str) -> str:
    """An SQL string."""
    return "'" + text.replace("'", "''") + "'"


EDGE = r"[ \t\n\r,()=<>+\-*/;]"


def normalized(expr: str) -> str:
    out = f"regexp_replace({expr}, {q(chr(39) + '(?:[^' + chr(39) + ']|' + chr(39) * 2 + ')*' + chr(39) + '?')}, "
    out += f"{q(chr(39) + '?' + chr(39))}, 'g')"
    number = q(rf"(^|{EDGE})[0-9][0-9.]*($|{EDGE})")
    for _ in range(2):
        out = f"regexp_replace({out}, {number}, {q(chr(92) + '1?' + chr(92) + '2')}, 'g')"
    out = f"regexp_replace({out}, {q('[ ' + chr(92) + 't' + chr(92) + 'n' + chr(92) + 'r]+')}, ' ', 'g')"
    return f"trim({out}, ' ')"


def op_name(expr: str) -> str:
    whens = " ".join(f"WHEN {code} THEN {q(name)}" for code, name in OP_NAMES.items())
    return f"(CASE {expr} {whens} ELSE concat('UnknownOp(', CAST({expr} AS VARCHAR), ')') END)"


def format_us(us: str) -> str:
    """Duration text of whole microseconds."""
    seconds = f"(({us}) // 1000000 + (({us}) % 1000000) / 1000000.0::DOUBLE)"
    return (
        f"(CASE WHEN {us} IS NULL THEN '-' WHEN ({us}) < 1000 THEN concat(CAST({us} AS VARCHAR), 'µs')"
        f" WHEN ({us}) < 1000000 THEN concat(printf('%.1f', ({us}) / 1000.0::DOUBLE), 'ms')"
        f" ELSE concat(printf('%.2f', {seconds}), 's') END)"
    )


def format_ms(ms: str, web: bool = False) -> str:
    """Duration text of a double of milliseconds; the browser rounds exact ties up."""

    def shown(value: str, digits: int) -> str:
        if not web:
            return f"printf('%.{digits}f', {value})"
        scale = 10**digits
        # An exact tie is a value whose scaled double and half are both exact in binary.
        exact = f"({value}) * 1024 = floor(({value}) * 1024) AND ({value}) * {scale} - floor(({value}) * {scale}) = 0.5"
        up = f"printf('%.{digits}f', (floor(({value}) * {scale}) + 1) / {scale}.0::DOUBLE)"
        return f"CASE WHEN {exact} THEN {up} ELSE printf('%.{digits}f', {value}) END"

    micros = f"floor(({ms}) * 1000 + 0.5)" if web else f"round_even(({ms}) * 1000, 0)"
    return (
        f"(CASE WHEN ({ms}) < 1 THEN concat(CAST(CAST({micros} AS BIGINT) AS VARCHAR), 'µs')"
        f" WHEN ({ms}) < 1000 THEN concat({shown(ms, 1)}, 'ms') ELSE concat({shown(f'({ms}) / 1000', 2)}, 's') END)"
    )


def trimmed(value: str, width: int) -> str:
    """.fraction without trailing zeros, or nothing."""
    digits = f"regexp_replace(lpad(CAST({value} AS VARCHAR), {width}, '0'), '0+$', '')"
    return f"(CASE WHEN {digits} = '' THEN '' ELSE concat('.', {digits}) END)"


def duration_text(ns: str) -> str:
    def unit(by: int, width: int, suffix: str) -> str:
        return f"concat(CAST(({ns}) // {by} AS VARCHAR), {trimmed(f'(({ns}) % {by})', width)}, {q(suffix)})"

    sec = f"(({ns}) // 1000000000)"
    in_minute = f"concat(CAST({sec} % 60 AS VARCHAR), {trimmed(f'(({ns}) % 1000000000)', 9)}, 's')"
    return (
        f"(CASE WHEN ({ns}) = 0 THEN '0s' WHEN ({ns}) < 1000 THEN concat(CAST({ns} AS VARCHAR), 'ns')"
        f" WHEN ({ns}) < 1000000 THEN {unit(1000, 3, 'µs')} WHEN ({ns}) < 1000000000 THEN {unit(1000000, 6, 'ms')}"
        f" WHEN {sec} < 60 THEN {in_minute} WHEN {sec} < 3600 THEN concat(CAST({sec} // 60 AS VARCHAR), 'm', {in_minute})"
        f" ELSE concat(CAST({sec} // 3600 AS VARCHAR), 'h', CAST({sec} // 60 % 60 AS VARCHAR), 'm', {in_minute}) END)"
    )


def clock(us: str, millis: bool = True) -> str:
    return f"strftime(make_timestamp({us}), {q('%H:%M:%S.%g' if millis else '%H:%M:%S')})"


def rfc3339(us: str) -> str:
    return f"concat(strftime(make_timestamp({us}), '%Y-%m-%dT%H:%M:%S'), {trimmed(f'(({us}) % 1000000)', 6)}, 'Z')"


ARGS = "array_to_string(args, '|')"
SELECT = "(op IN (0, 1, 4) AND regexp_matches(query, '(?i)^[[:space:]]*SELECT'))"
FROM = "regexp_matches(query, '(?i)(^|[^0-9A-Za-z_])FROM([^0-9A-Za-z_]|$)')"
SHOWN_ARGS = (
    "CASE WHEN len(args) > 0 THEN concat('[', array_to_string("
    "list_transform(args, lambda a: concat(chr(39), a, chr(39))), ', '), ']') ELSE '' END"
)
STATUS = "CASE WHEN error <> '' THEN 'E' WHEN n_plus_1 THEN 'N+1' WHEN slow_query THEN 'SLOW' ELSE '' END"

LOG = f"log AS ({statement_log_duckdb()})"
TPL = f"tpl AS (SELECT *, {normalized('query')} AS normalized_query, dur_us >= 100000 AS slow_query FROM log)"
TX = """
tx AS (
  SELECT *, CASE WHEN begin_seq > coalesce(end_seq, -1)
      THEN concat(CAST(conn_id AS VARCHAR), '-', CAST(begin_seq AS VARCHAR)) END AS tx_id
  FROM (SELECT *, max(CASE WHEN op = 5 THEN seq END) OVER (PARTITION BY conn_id ORDER BY seq) AS begin_seq,
      max(CASE WHEN op IN (6, 7) THEN seq END) OVER (
        PARTITION BY conn_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS end_seq
    FROM {source}))
"""


def counted(key: str) -> str:
    """Watched statements with the count in the window."""
    return f"""
    counted AS (
      SELECT key, start_us, seq, rn - min(rn) OVER (
          PARTITION BY key ORDER BY start_us RANGE BETWEEN 1000000 PRECEDING AND CURRENT ROW) + 1 AS cnt
      FROM (SELECT {key} AS key, start_us, seq,
              row_number() OVER (PARTITION BY {key} ORDER BY start_us, seq) AS rn
            FROM tpl WHERE {SELECT} AND {FROM})),
    ev AS (SELECT tpl.*, coalesce(c.cnt >= 5, false) AS n_plus_1 FROM tpl LEFT JOIN counted c USING (seq))
    """


CHAIN = """
hit AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key, start_us ORDER BY seq) AS tie
    FROM counted WHERE cnt >= 5) WHERE tie = 1),
jump AS (SELECT *, min(start_us) OVER (PARTITION BY key ORDER BY start_us
    RANGE BETWEEN 10000000 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt,
    row_number() OVER (PARTITION BY key ORDER BY start_us) AS nth FROM hit),
alert AS (
  SELECT key, start_us, seq, cnt, nxt FROM jump WHERE nth = 1
  UNION ALL
  SELECT j.key, j.start_us, j.seq, j.cnt, j.nxt FROM alert a JOIN jump j ON j.key = a.key AND j.start_us = a.nxt)
"""


def with_(*ctes: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(ctes) + "\n"


def add(name: str, body: str, *ctes: str, recursive: bool = False) -> None:
    ORACLES[name] = with_(*(ctes or (LOG,)), recursive=recursive) + body


BASE = (LOG, TPL)
FLAGGED = (LOG, TPL, counted("query"))
LABELLED = (LOG, TX.format(source="log"))
EVENTS = (LOG, TPL, counted("query"), TX.format(source="ev"))

FLAT = f"SELECT seq, conn_id, op, query, {ARGS} AS args, start_us, dur_us, rows_affected, error FROM log"
for name in ("read_statement_log_parquet", "read_statement_log_json", "stream_log"):
    add(name, FLAT)
add(
    "read_feed",
    f"SELECT seq, op, query, {ARGS} AS args, start_us, dur_us, rows_affected, error, coalesce(tx_id, '') AS tx_id,"
    " n_plus_1, slow_query, normalized_query FROM tx",
    *EVENTS,
)
add(
    "event_json",
    f"""SELECT seq, concat('{{"id":', to_json(CAST(seq AS VARCHAR)), ',"op":"', {op_name('op')}, '","query":', to_json(query),
    ',"args":', to_json(args), ',"start_time":"', {rfc3339('start_us')}, '","duration_ms":',
    to_json(dur_us / 1000.0::DOUBLE), ',"rows_affected":', CAST(rows_affected AS VARCHAR),
    CASE WHEN error <> '' THEN concat(',"error":', to_json(error)) ELSE '' END,
    CASE WHEN tx_id IS NOT NULL THEN concat(',"tx_id":"', tx_id, '"') ELSE '' END,
    CASE WHEN n_plus_1 THEN ',"n_plus_1":true' ELSE '' END, CASE WHEN slow_query THEN ',"slow_query":true' ELSE '' END,
    ',"normalized_query":', to_json(normalized_query), '}}') AS json FROM tx""",
    *EVENTS,
)
add(
    "sanitize_event",
    """SELECT seq, concat(query, chr(65533)) AS query, array_to_string(list_transform(args, lambda a: concat(a, chr(65533))), '|') AS args,
      concat(error, repeat(chr(65533), 2)) AS error, concat(normalized_query, repeat(chr(65533), 3)) AS normalized_query FROM tpl""",
    *BASE,
)
add("sanitize_utf8", "SELECT seq, concat(query, chr(65533), error, chr(65533), chr(65533), 'z') AS query FROM log")

FILTERED = "regexp_matches(query, '(?i)^[[:space:]]*select') AND dur_us > 100000"
SEARCHED = f"({FILTERED} AND contains(lower(query), 'users'))"


def stats_of(source: str, key: str = "normalized_query") -> str:
    return f"""
    SELECT {key} AS k, count(*) AS n, CAST(sum(dur_us) AS BIGINT) AS total,
      list_sort(list(dur_us))[CAST(floor(CAST(count(*) - 1 AS DOUBLE) * 0.95::DOUBLE) AS BIGINT) + 1] AS p95,
      max(dur_us) AS largest, min(seq) AS first_seq
    FROM ({source}) WHERE op NOT IN (2, 3, 5, 6, 7) AND {key} <> '' GROUP BY 1"""


def export_ctes(where: str) -> tuple[str, ...]:
    return (
        f"kept AS (SELECT *, row_number() OVER (ORDER BY seq) AS position FROM tx WHERE {where})",
        f"st AS ({stats_of('SELECT * FROM kept')})",
        f"""su AS (SELECT (SELECT count(*) FROM tx) AS captured, count(*) AS exported,
          coalesce({clock('min_by(start_us, seq)', False)}, '') AS p0,
          coalesce({clock('max_by(start_us, seq)', False)}, '') AS p1 FROM kept)""",
    )


def markdown(where: str, suffix: str, web: bool, offset: int = 0) -> str:
    args = f"replace({SHOWN_ARGS}, '|', concat(chr(92), '|'))" if web else SHOWN_ARGS
    pipe = "concat(chr(92), '|')"
    head = [q(TITLE), "''", "concat('- Captured: ', CAST(captured AS VARCHAR), ' queries')"]
    head += [f"concat('- Exported: ', CAST(exported AS VARCHAR), ' queries', {q(suffix)})"]
    head += ["CASE WHEN p0 <> '' THEN concat('- Period: ', p0, ' — ', p1) END", "''", "'## Queries'", "''"]
    head += ["'| # | Time | Op | Duration | Query | Args | Error |'"]
    head += ["'|---|------|----|----------|-------|------|-------|'"]
    stats_head = ["''", "'## Analytics'", "''", "'| Query | Count | Avg | P95 | Max | Total |'"]
    stats_head += ["'|-------|-------|-----|-----|-----|-------|'"]
    parts = [
        f"SELECT {offset} AS section, CAST({i} AS BIGINT) AS position, {line} AS line FROM su" for i, line in enumerate(head)
    ]
    parts.append(
        f"SELECT {1 + offset}, position, concat_ws(' | ', concat('| ', CAST(position AS VARCHAR)), {clock('start_us')},"
        f" {op_name('op')}, {format_ms('dur_us / 1000.0::DOUBLE', web)}, replace(query, '|', {pipe}), {args},"
        f" concat(replace(error, '|', {pipe}), ' |')) FROM kept"
    )
    parts += [
        f"SELECT {2 + offset}, CAST({i} AS BIGINT), {line} FROM su WHERE (SELECT count(*) FROM st) > 0"
        for i, line in enumerate(stats_head)
    ]
    total = "total / 1000.0::DOUBLE"
    cells = ", ".join(
        format_ms(v, web) for v in (f"({total}) / n", "p95 / 1000.0::DOUBLE", "largest / 1000.0::DOUBLE")
    )
    parts.append(
        f"SELECT {3 + offset}, first_seq, concat_ws(' | ', concat('| ', replace(k, '|', {pipe})), CAST(n AS VARCHAR),"
        f" {cells}, concat({format_ms(total, web)}, ' |')) FROM st"
    )
    return "SELECT * FROM (" + "\nUNION ALL ".join(parts) + ") WHERE line IS NOT NULL"


TX_TPL = (LOG, TPL, TX.format(source="tpl"))
add(
    "export_markdown",
    markdown("true", " (filter: op:select d>100ms, search: users)", False),
    *TX_TPL,
    *export_ctes(SEARCHED),
)
add("export_markdown_all", markdown("true", "", False), *TX_TPL, *export_ctes("true"))


def web_text(word: str) -> str:
    places = f"contains(lower({op_name('op')}), {q(word)}) OR contains(lower(error), {q(word)})"
    return f"(contains(lower(query), {q(word)}) OR {places})"


_WEB = [
    (f"{web_text('key|s')} AND dur_us > 1000", " (filter: key\\|s d>1ms)", 0),
    (web_text("execute"), " (filter: execute)", 10),
]
add(
    "export_markdown_web",
    "\nUNION ALL ".join(
        f"SELECT * FROM ({with_(*TX_TPL, *export_ctes(where))}{markdown('true', suffix, True, offset)})"
        for where, suffix, offset in _WEB
    ),
    "one AS (SELECT 1)",
)
_JSON_HEAD = [
    "'{'",
    """concat('  "captured": ', CAST(captured AS VARCHAR), ',')""",
    """concat('  "exported": ', CAST(exported AS VARCHAR), ',')""",
    """'  "filter": "op:select d>100ms",'""",
    """'  "search": "users",'""",
    """concat('  "period": {"start":"', p0, '","end":"', p1, '"},')""",
    """'  "queries": ['""",
]
add(
    "export_json",
    "SELECT * FROM ("
    + "\nUNION ALL ".join(
        [
            f"SELECT {s} AS section, CAST({i} AS BIGINT) AS position, {line} AS line FROM su"
            for s, lines in ((0, _JSON_HEAD), (2, ["'  ],'", "'  \"analytics\": ['"]), (4, ["'  ]'", "'}'"]))
            for i, line in enumerate(lines)
        ]
        + [
            f"""SELECT 1, position, concat('    {{"time":"', {clock('start_us')}, '","op":"', {op_name('op')}, '","query":',
            to_json(query), ',"args":', to_json(args), ',"duration_ms":', to_json(dur_us / 1000.0::DOUBLE),
            ',"rows_affected":', CAST(rows_affected AS VARCHAR), ',"error":', to_json(error), ',"tx_id":"',
            coalesce(tx_id, ''), '"}}', CASE WHEN position < (SELECT exported FROM su) THEN ',' ELSE '' END) FROM kept""",
            """SELECT 3, first_seq, concat('    {"query":', to_json(k), ',"count":', CAST(n AS VARCHAR), ',"total_ms":',
            to_json(total / 1000.0::DOUBLE), ',"avg_ms":', to_json((total / 1000.0::DOUBLE) / n), ',"p95_ms":',
            to_json(p95 / 1000.0::DOUBLE), ',"max_ms":', to_json(largest / 1000.0::DOUBLE), '}',
            CASE WHEN first_seq < (SELECT max(first_seq) FROM st) THEN ',' ELSE '' END) FROM st""",
        ]
    )
    + ")",
    *TX_TPL,
    *export_ctes(SEARCHED),
)
add(
    "fanout_sinks",
    f"""SELECT subscriber, count(*) AS n, CAST(sum(seq) AS BIGINT) AS seqs FROM (
      SELECT 'all' AS subscriber, seq FROM tpl UNION ALL SELECT 'errors', seq FROM tpl WHERE error <> ''
      UNION ALL SELECT 'slow', seq FROM tpl WHERE slow_query UNION ALL SELECT 'selects', seq FROM tpl WHERE {SELECT})
    GROUP BY 1""",
    *BASE,
)

# Events rebuilt from messages
WIRE = (LOG, WIRE_DUCKDB)
PAIRED = """
paired AS (SELECT * FROM (
  SELECT *, lead(kind) OVER w AS answer, lead(us) OVER w AS answer_us, lead(tag) OVER w AS answer_tag,
    lead(msg) OVER w AS answer_msg
  FROM wire WHERE kind IN ('REQ', 'EXEC', 'DONE', 'ERR') WINDOW w AS (PARTITION BY conn_id ORDER BY msg))
  WHERE kind IN ('REQ', 'EXEC') AND answer IN ('DONE', 'ERR'))
"""
TAG_ROWS = "coalesce(try_cast(split(answer_tag, ' ')[-1] AS BIGINT), 0)"
PAIR_VALUES = (
    f"CASE WHEN answer = 'ERR' THEN 0 ELSE {TAG_ROWS} END AS rows_affected,"
    " CASE WHEN answer = 'ERR' THEN answer_tag ELSE '' END AS error"
)
add("pair_requests", f"SELECT msg, conn_id, kind, answer_msg, {PAIR_VALUES} FROM paired", *WIRE, PAIRED)
add("statement_duration", "SELECT msg, us AS start_us, answer_us - us AS dur_us FROM paired", *WIRE, PAIRED)
PREPARED = """
located AS (SELECT *, last_value(CASE WHEN kind = 'BIND' THEN {{'stmt': stmt, 'args': args}} END IGNORE NULLS) OVER w AS bind,
    last_value(CASE WHEN kind = 'PARSE' THEN query END IGNORE NULLS) OVER w AS any_query
  FROM wire WHERE kind IN ('PARSE', 'BIND', 'EXEC')
  WINDOW w AS (PARTITION BY conn_id ORDER BY msg ROWS UNBOUNDED PRECEDING)),
prepared AS (SELECT * FROM (SELECT msg, conn_id, kind, name AS stmt,
    last_value(CASE WHEN kind = 'PARSE' THEN query END IGNORE NULLS) OVER (
      PARTITION BY conn_id, name ORDER BY msg ROWS UNBOUNDED PRECEDING) AS named, any_query, bind
  FROM (SELECT *, coalesce(CASE WHEN kind = 'EXEC' THEN bind.stmt ELSE stmt END, '') AS name FROM located)
  WHERE kind IN ('PARSE', 'EXEC')) WHERE kind = 'EXEC')
""".replace("{{", "{").replace("}}", "}")
PREPARED_TEXT = "coalesce(CASE WHEN stmt <> '' THEN named END, any_query, '')"
add(
    "resolve_prepared",
    f"SELECT msg, conn_id, stmt, {PREPARED_TEXT} AS query, array_to_string(coalesce(bind.args, []), '|') AS args FROM prepared",
    *WIRE,
    PREPARED,
)
add(
    "resolve_prepared_mysql",
    """SELECT msg, conn_id, name AS stmt, CASE WHEN known.closed THEN '' ELSE coalesce(known.query, '') END AS query FROM (
      SELECT *, last_value(CASE WHEN k = 'PARSE' THEN {'query': query, 'closed': false}
          WHEN k = 'CLOSE' THEN {'query': CAST(NULL AS VARCHAR), 'closed': true} END IGNORE NULLS) OVER (
          PARTITION BY conn_id, name ORDER BY msg ROWS UNBOUNDED PRECEDING) AS known
      FROM (SELECT *, concat('s', CAST(seq % 3 AS VARCHAR)) AS name,
          CASE WHEN kind = 'RFQ' AND seq % 3 = 1 THEN 'CLOSE' ELSE kind END AS k FROM wire)
      WHERE k IN ('PARSE', 'EXEC', 'CLOSE')) WHERE k = 'EXEC'""",
    *WIRE,
)
# In this log an answer never comes without a question, so plain ordinals match them.
DESCRIBED = """
cycles AS (SELECT *, sum(CASE WHEN kind = 'RFQ' THEN 1 ELSE 0 END) OVER (PARTITION BY conn_id ORDER BY msg) AS cyc
  FROM wire WHERE kind IN ('DESC', 'PD', 'RFQ')),
nth AS (SELECT *, row_number() OVER (PARTITION BY conn_id, cyc, kind ORDER BY msg) AS n FROM cycles),
described AS (SELECT p.msg, p.conn_id, d.stmt, p.oids FROM nth p JOIN nth d
  ON p.kind = 'PD' AND d.kind = 'DESC' AND p.conn_id = d.conn_id AND p.cyc = d.cyc AND p.n = d.n)
"""
add(
    "match_descriptions",
    "SELECT msg, conn_id, stmt, array_to_string(CAST(oids AS VARCHAR[]), '|') AS oids FROM described",
    *WIRE,
    DESCRIBED,
)
add(
    "resolve_param_types",
    """SELECT msg, conn_id, stmt, array_to_string(CAST(coalesce(named, general, []) AS VARCHAR[]), '|') AS oids FROM (
      SELECT *, last_value(CASE WHEN kind = 'PARSE' OR (kind = 'PD' AND stmt = '') THEN oids END IGNORE NULLS) OVER (
          PARTITION BY conn_id ORDER BY msg ROWS UNBOUNDED PRECEDING) AS general,
        last_value(CASE WHEN kind IN ('PARSE', 'PD') AND stmt <> '' THEN oids END IGNORE NULLS) OVER (
          PARTITION BY conn_id, stmt ORDER BY msg ROWS UNBOUNDED PRECEDING) AS named
      FROM (SELECT msg, conn_id, kind, stmt, oids FROM wire WHERE kind IN ('PARSE', 'BIND')
        UNION ALL SELECT msg, conn_id, 'PD', stmt, oids FROM described)) WHERE kind = 'BIND'""",
    *WIRE,
    DESCRIBED,
)
_DOUBLE = "regexp_replace(CAST({v} AS VARCHAR), '[.]0$', '')"
_PARAMS = {
    "pg_int8": "CAST(-seq AS VARCHAR)",
    "pg_int4": "CAST(seq - 500 AS VARCHAR)",
    "pg_int2": "CAST(-conn_id AS VARCHAR)",
    "pg_int1": "CAST(conn_id - 10 AS VARCHAR)",
    "pg_time": rfc3339("start_us * 3600"),
    "pg_uuid": "regexp_replace(md5(query), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5')",
    "pg_text": "concat('text of statement ', query)",
    "mysql_tiny": "CAST(-conn_id AS VARCHAR)",
    "mysql_short": "CAST(seq % 1000 - 500 AS VARCHAR)",
    "mysql_long": "CAST(-seq AS VARCHAR)",
    "mysql_longlong": "CAST(start_us AS VARCHAR)",
    "mysql_text": "query",
    "mysql_null": "'NULL'",
    "mysql_short_data": "'?'",
    "tidb_long": "CAST(seq AS VARCHAR)",
    "tidb_text": "query",
    "mysql_no_type": "query",
    "no_protocol": "query",
    "mysql_double": _DOUBLE.format(v="value"),
    "mysql_float": _DOUBLE.format(v="CAST(value AS FLOAT)"),
}
add(
    "decode_params",
    "\nUNION ALL ".join(f"SELECT seq, {q(w)} AS what, {e} AS value FROM logv" for w, e in _PARAMS.items()),
    LOG,
    "logv AS (SELECT *, dur_us / 1000.0::DOUBLE AS value FROM log)",
)
add(
    "binary_format_flags",
    """SELECT seq, array_to_string(list_transform(args, lambda a, i: CASE seq % 4 WHEN 0 THEN 'false'
        WHEN 1 THEN CASE WHEN (1 + conn_id) % 2 = 1 THEN 'true' ELSE 'false' END
        ELSE CASE WHEN i <= seq % 4 AND (i + conn_id) % 2 = 1 THEN 'true' ELSE 'false' END END), '|') AS flags FROM log""",
)
add("assign_tx", "SELECT seq, conn_id, op, tx_id FROM tx", *LABELLED)
add(
    "classify_op",
    "SELECT seq, CASE query WHEN 'BEGIN' THEN 5 WHEN 'COMMIT' THEN 6 WHEN 'ROLLBACK' THEN 7 ELSE 0 END AS op FROM log",
)
add(
    "rows_affected",
    "SELECT msg, coalesce(try_cast(split(tag, ' ')[-1] AS BIGINT), 0) AS rows_affected FROM wire WHERE tag IS NOT NULL",
    *WIRE,
)
add(
    "rebuild_statements",
    f"""SELECT t.seq, t.conn_id, t.op, t.query, array_to_string(t.args, '|') AS args, p.us AS start_us,
      p.answer_us - p.us AS dur_us, {PAIR_VALUES}, tx_id FROM tx t JOIN paired p ON p.msg = t.seq""",
    *WIRE,
    PAIRED,
    PREPARED,
    f"""requests AS (
      SELECT w.msg AS seq, w.conn_id, text AS query, args,
        CASE WHEN text LIKE 'BEGIN%' THEN 5 WHEN text LIKE 'COMMIT%' THEN 6 WHEN text LIKE 'ROLLBACK%' THEN 7
          WHEN kind = 'EXEC' THEN 4 ELSE 0 END AS op
      FROM (SELECT w.msg, w.conn_id, w.kind, CASE WHEN w.kind = 'EXEC' THEN p.text ELSE w.query END AS text,
          coalesce(p.args, []) AS args
        FROM wire w LEFT JOIN (SELECT msg, {PREPARED_TEXT} AS text, bind.args AS args FROM prepared) p ON p.msg = w.msg
        WHERE w.kind IN ('REQ', 'EXEC')) w)""",
    TX.format(source="requests"),
)
ORACLES["rebuild_statements_bytes"] = ORACLES["rebuild_statements"]
add(
    "rebuild_statements_mysql",
    f"""SELECT t.seq, t.conn_id, t.op, t.query, t.args, p.us AS start_us, p.answer_us - p.us AS dur_us,
      CASE WHEN answer = 'ERR' OR p.seq_no % 5 = 0 THEN 0 ELSE p.seq_no % 50 END AS rows_affected,
      CASE WHEN answer = 'ERR' THEN answer_tag ELSE '' END AS error, tx_id FROM tx t JOIN mpaired p ON p.msg = t.seq""",
    *WIRE,
    """mwire AS (SELECT * EXCLUDE (kind), CASE WHEN kind = 'RFQ' AND seq % 3 = 1 THEN 'CLOSE' ELSE kind END AS kind,
        concat('s', CAST(seq % 3 AS VARCHAR)) AS name FROM wire WHERE kind IN ('REQ', 'PARSE', 'EXEC', 'DONE', 'ERR', 'RFQ'))""",
    """mpaired AS (SELECT * FROM (SELECT msg, us, kind, lead(seq) OVER w AS seq_no, lead(kind) OVER w AS answer, lead(us) OVER w AS answer_us, lead(tag) OVER w AS answer_tag
        FROM mwire WHERE kind IN ('REQ', 'EXEC', 'DONE', 'ERR') WINDOW w AS (PARTITION BY conn_id ORDER BY msg))
        WHERE kind IN ('REQ', 'EXEC') AND answer IN ('DONE', 'ERR'))""",
    """mtext AS (SELECT msg, CASE WHEN known.closed THEN '' ELSE coalesce(known.query, '') END AS text FROM (
        SELECT msg, kind, last_value(CASE WHEN kind = 'PARSE' THEN {'query': query, 'closed': false}
          WHEN kind = 'CLOSE' THEN {'query': CAST(NULL AS VARCHAR), 'closed': true} END IGNORE NULLS) OVER (
          PARTITION BY conn_id, name ORDER BY msg ROWS UNBOUNDED PRECEDING) AS known FROM mwire WHERE kind IN ('PARSE', 'EXEC', 'CLOSE')) WHERE kind = 'EXEC')""",
    """requests AS (SELECT seq, conn_id, query, args, CASE WHEN query LIKE 'BEGIN%' THEN 5 WHEN query LIKE 'COMMIT%' THEN 6
          WHEN query LIKE 'ROLLBACK%' THEN 7 WHEN kind = 'EXEC' THEN 4 ELSE 0 END AS op FROM (
        SELECT w.msg AS seq, w.conn_id, w.kind, CASE WHEN w.kind = 'EXEC' THEN m.text ELSE w.query END AS query,
          CASE WHEN w.kind = 'EXEC' THEN concat(CAST(w.seq AS VARCHAR), '|v', CAST(w.seq AS VARCHAR), '|NULL') ELSE '' END AS args
        FROM mwire w LEFT JOIN mtext m ON m.msg = w.msg WHERE w.kind IN ('REQ', 'EXEC')))""",
    TX.format(source="requests"),
)

# Enrichment
add("normalize_query", "SELECT seq, normalized_query FROM tpl", *BASE)
add("normalize_documents", f"SELECT doc_id, md5({normalized('text')}) AS template FROM documents", "one AS (SELECT 1)")
add("is_select", f"SELECT seq, {SELECT} AS is_select FROM log")
add("is_metadata_query", f"SELECT seq, {SELECT} AND NOT {FROM} AS is_metadata FROM log")
add("nplus1_flags", "SELECT seq, n_plus_1 FROM ev", *FLAGGED)
add("nplus1_flags_template", "SELECT seq, n_plus_1 FROM ev", LOG, TPL, counted("normalized_query"))
for name, key in (("nplus1_alerts", "query"), ("nplus1_alerts_template", "normalized_query")):
    add(name, "SELECT key, start_us, seq, cnt FROM alert", LOG, TPL, counted(key), CHAIN, recursive=True)
# By arrival: the detector's list is replayed literally, every text one statement a step; `head` is the list's first place.
_ARRIVED = (
    LOG,
    f"""done AS (
      SELECT * EXCLUDE (seq), row_number() OVER (ORDER BY start_us + coalesce(dur_us, 0) + CASE WHEN seq % 37 = 0 THEN 20000000 ELSE 0 END, seq) AS seq FROM log)""",
    f"""lists AS (
      SELECT query AS key, list(start_us ORDER BY seq) AS times, list(seq ORDER BY seq) AS seqs FROM done WHERE {SELECT} AND {FROM} GROUP BY 1)""",
    """steps AS (
      SELECT key, 0::BIGINT AS n, 1::BIGINT AS head, NULL::BIGINT AS last, false AS flagged, false AS alert FROM lists
      UNION ALL
      SELECT key, n, head, CASE WHEN n - head + 1 >= 5 AND (last IS NULL OR t - last >= 10000000) THEN t ELSE last END,
        n - head + 1 >= 5, n - head + 1 >= 5 AND (last IS NULL OR t - last >= 10000000)
      FROM (SELECT s.key, n + 1 AS n, last, times[n + 1] AS t,
          head + list_position(list_transform(times[head : n + 1], lambda x: x >= times[n + 1] - 1000000), true) - 1 AS head
        FROM steps s JOIN lists USING (key) WHERE n < len(times)))""",
    "shown AS (SELECT key, times[n] AS start_us, seqs[n] AS seq, n - head + 1 AS cnt, flagged, alert FROM steps JOIN lists USING (key) WHERE n > 0)",
)
add("nplus1_flags_arrival", "SELECT seq, coalesce(flagged, false) AS n_plus_1 FROM done LEFT JOIN shown USING (seq)", *_ARRIVED, recursive=True)
add("nplus1_alerts_arrival", "SELECT key, start_us, seq, cnt FROM shown WHERE alert", *_ARRIVED, recursive=True)
add("slow_flags", "SELECT seq, slow_query FROM tpl", *BASE)
BAR = "CASE WHEN error <> '' THEN 'error' WHEN n_plus_1 THEN 'nplus1' WHEN slow_query THEN 'slow' ELSE 'normal' END"
add("event_status", f"SELECT seq, {STATUS} AS status, {BAR} AS bar FROM ev", *FLAGGED)
add("event_status_counts", f"SELECT {STATUS} AS status, count(*) AS n FROM ev GROUP BY 1", *FLAGGED)
add(
    "typed_args",
    """SELECT seq, array_to_string(list_transform(args, lambda a, i:
        CASE WHEN regexp_matches(a, '^[0-9]+$') THEN CASE WHEN i = 1 AND contains(query, '$1')
            THEN concat('ts:', CAST(946684800000000 + CAST(a AS BIGINT) * 1000000 AS VARCHAR)) ELSE concat(a, '000000') END
          ELSE a END), '|') AS args FROM log""",
)
_BRIEN = "concat(chr(39), 'O', chr(39), chr(39), 'Brien', chr(39))"
_BOUND = f"CASE WHEN len(args) = 0 THEN query ELSE replace(replace(query, '$2', {_BRIEN}), '$1', args[1]) END"
for name in ("bind_args", "bind_args_marks", "bind_args_web"):
    add(name, f"SELECT seq, {_BOUND} AS bound FROM log")
add("op_names", f"SELECT seq, {op_name('(op + op % 3 * 4)')} AS op_name FROM log")
_LABEL = "CASE WHEN n_plus_1 THEN 'N+1 detected: ' ELSE 'Slow query: ' END"
add(
    "alert_feed",
    f"""SELECT seq, concat({_LABEL}, CASE WHEN length(query) > 60 THEN concat(substr(query, 1, 57), '...') ELSE query END)
      AS line FROM ev WHERE n_plus_1 OR slow_query""",
    *FLAGGED,
)
add(
    "alert_feed_web",
    f"SELECT seq, concat({_LABEL}, substr(query, 1, 80)) AS line FROM ev WHERE n_plus_1 OR slow_query",
    *FLAGGED,
)

# Filters
_ROW = "SELECT seq, query, dur_us FROM"
add("filter_duration", f"{_ROW} log WHERE dur_us > 12500 AND dur_us < 100000")
add("filter_error", f"{_ROW} log WHERE error <> ''")
add("filter_nplus1", f"{_ROW} ev WHERE n_plus_1", *FLAGGED)
add("filter_slow", f"{_ROW} tpl WHERE slow_query", *BASE)
add("filter_op_protocol", f"{_ROW} log WHERE op = 4")
add("filter_op_keyword", f"{_ROW} log WHERE starts_with(lower(trim(query)), 'update')")
add("filter_text", f"{_ROW} log WHERE contains(lower(query), 'posts')")
add("filter_text_web", f"{_ROW} log WHERE {web_text('key')}")
add("filter_combined", f"{_ROW} log WHERE {FILTERED}")
add(
    "filter_unknown_op",
    """SELECT p.pattern, count(*) FILTER (WHERE CASE p.pattern WHEN 'execute' THEN op = 4 WHEN 'begin' THEN op = 5
        WHEN 'select' THEN starts_with(lower(trim(query)), 'select')
        WHEN 'update' THEN starts_with(lower(trim(query)), 'update') ELSE false END) AS matched, count(*) AS total
    FROM log, (VALUES ('select'), ('update'), ('execute'), ('begin'), ('merge'), ('op:query')) p(pattern) GROUP BY 1""",
)
# More nanoseconds than 63 bits hold make the token a text.
add(
    "filter_large_duration",
    f"""SELECT CASE WHEN us > 9223372036854775 THEN concat('text:d>', CAST(us AS VARCHAR), 'us text:users')
        ELSE concat('d>', {duration_text("CAST(least(us, 9223372036854775) * 1000 AS BIGINT)")}, ' text:users') END AS canonical, count(*) AS n
    FROM (SELECT CAST(start_us AS HUGEINT) * CASE seq % 3 WHEN 0 THEN 1 WHEN 1 THEN 10000 ELSE 100000000 END AS us FROM log) GROUP BY 1""",
)
add(
    "search_text",
    f"{_ROW} log WHERE starts_with(lower(trim(query)), 'select') AND contains(lower(query), 'from users where')",
)
_NS = "(CAST(floor(value) AS BIGINT) * 1000000)"
add(
    "describe_filter",
    f"""SELECT concat('op:select d>', {duration_text(_NS)}, ' ',
        CASE WHEN event_type IN ('error', 'slow') THEN event_type ELSE concat('text:', event_type) END, ' d<1.5s n+1')
      AS canonical, count(*) AS n FROM events GROUP BY 1""",
    "one AS (SELECT 1)",
)
add(
    "template_p95_approx",
    """SELECT normalized_query, count(*) AS n, true AS within FROM tpl
    WHERE op NOT IN (2, 3, 5, 6, 7) AND normalized_query <> '' GROUP BY 1""",
    *BASE,
)
_PICK = "[{}][CAST(floor(value * {}) AS BIGINT) % {} + 1]"


def _pick(by: int, *choices: str) -> str:
    return _PICK.format(", ".join(map(q, choices)), by, len(choices))


# Every saved line against every statement, condition by condition.
add(
    "saved_filter_matches",
    f"""SELECT canonical, saved, matched, (SELECT count(*) FROM ev) AS total FROM (
      SELECT canonical, count(*) AS saved, any_value(matched) AS matched FROM lines JOIN counted_lines USING (line) GROUP BY 1)""",
    *FLAGGED,
    f"""lines AS (
      SELECT concat({_pick(1, "op:select ", "op:UPDATE ", "", "op:execute ", "op:merge ")},
        {_pick(10, "users ", "POSTS ", "", "e ", "event_type ", "from users ", "u")}, {_pick(100, "d>", "d<")},
        CAST(CAST(floor(value) AS BIGINT) % 50 AS VARCHAR), {_pick(7, "ms", ".5ms slow", "ms ERROR", "0us", "ms n+1")}) AS line FROM events
      UNION ALL
      SELECT concat(' OP:Select  d>', CAST(CAST(floor(value) AS BIGINT) AS VARCHAR), 'ms ', event_type, '  d<1.5s n+1') FROM events)""",
    r"""tokens AS (
      SELECT line, i, lower(t) AS t
      FROM (SELECT line, unnest(regexp_extract_all(line, '[^ ]+')) AS t, generate_subscripts(regexp_extract_all(line, '[^ ]+'), 1) AS i
        FROM (SELECT DISTINCT line FROM lines)))""",
    r"""conds AS (
      SELECT line, i, t, CASE WHEN regexp_matches(t, '^d[><][0-9]+([.][0-9]+)?(us|ms|s)$') THEN CAST(CAST(regexp_extract(t, '[0-9.]+') AS DECIMAL(18, 3))
          * CASE WHEN t LIKE '%us' THEN 1000 WHEN t LIKE '%ms' THEN 1000000 ELSE 1000000000 END AS BIGINT) END AS ns FROM tokens)""",
    f"""named AS (
      SELECT line, string_agg(CASE WHEN ns IS NOT NULL THEN concat(substr(t, 1, 2), {duration_text("ns")}) WHEN t IN ('error', 'slow', 'n+1') THEN t
        WHEN t LIKE 'op:_%' THEN t ELSE concat('text:', t) END, ' ' ORDER BY i) AS canonical FROM conds GROUP BY 1)""",
    """met AS (
      SELECT line, seq, bool_and(CASE WHEN ns IS NOT NULL THEN CASE WHEN t LIKE 'd>%' THEN dur_us * 1000 > ns ELSE dur_us * 1000 < ns END
        WHEN t = 'error' THEN error <> '' WHEN t = 'slow' THEN slow_query WHEN t = 'n+1' THEN n_plus_1
        WHEN t = 'op:execute' THEN op = 4 WHEN t IN ('op:select', 'op:update') THEN starts_with(lower(trim(query)), substr(t, 4))
        WHEN t LIKE 'op:_%' THEN false ELSE contains(lower(query), t) END) AS yes
      FROM conds, (SELECT min(seq) AS seq, query, op, error, slow_query, n_plus_1, dur_us FROM ev GROUP BY ALL) GROUP BY 1, 2)""",
    """sizes AS (SELECT min(seq) AS seq, count(*) AS n FROM ev GROUP BY query, op, error, slow_query, n_plus_1, dur_us)""",
    """counted_lines AS (
      SELECT line, canonical, CAST(coalesce(sum(n) FILTER (WHERE yes), 0) AS BIGINT) AS matched FROM met JOIN named USING (line) JOIN sizes USING (seq) GROUP BY 1, 2)""",
)
add(
    "search_index",
    """SELECT search, count(text) AS texts, CAST(coalesce(sum(n), 0) AS BIGINT) AS matched
    FROM (SELECT DISTINCT CASE seq % 5 WHEN 1 THEN reverse(piece) WHEN 2 THEN upper(piece) ELSE piece END AS search
      FROM (SELECT seq, substr(query, CAST(seq % 23 + 1 AS BIGINT), CAST(seq % 9 AS BIGINT)) AS piece FROM log))
    LEFT JOIN (SELECT lower(query) AS text, count(*) AS n FROM log GROUP BY 1) ON contains(text, lower(search)) GROUP BY 1""",
)
add("match_counts", f"SELECT count(*) FILTER (WHERE {SEARCHED}) AS matched, count(*) AS total FROM log")

# Aggregations
_STATS = "k AS normalized_query, n, total AS total_us, total // n AS avg_us, p95 AS p95_us, largest AS max_us"
_MS = (
    "k AS normalized_query, n AS count, round(total / 1000.0::DOUBLE, 6) AS total_ms,"
    " round((total / 1000.0::DOUBLE) / n, 6) AS avg_ms, round(p95 / 1000.0::DOUBLE, 6) AS p95_ms,"
    " round(largest / 1000.0::DOUBLE, 6) AS max_ms"
)
ALL_STATS = f"st AS ({stats_of('SELECT * FROM tpl')})"
RAW_STATS = f"st AS ({stats_of('SELECT * FROM log', 'query')})"
add("template_stats", f"SELECT {_STATS} FROM st", *BASE, ALL_STATS)
add("template_stats_raw", f"SELECT {_STATS} FROM st", LOG, RAW_STATS)
add(
    "template_stats_export",
    f"SELECT {_MS}, first_seq FROM st",
    *BASE,
    f"st AS ({stats_of('SELECT * FROM tpl WHERE dur_us > 20000')})",
)
_HOLDS = "SELECT * FROM tpl WHERE contains(lower(normalized_query), 'users')"
add("template_stats_web", f"SELECT {_MS} FROM st", *BASE, f"st AS ({stats_of(_HOLDS)})")
add("template_p95", "SELECT k AS normalized_query, p95 AS p95_us FROM st", *BASE, ALL_STATS)
for mode, column in (("total", "total"), ("count", "n"), ("avg", "total // n"), ("p95", "p95"), ("max", "largest")):
    add(f"top_templates_by_{mode}", f"SELECT {_STATS} FROM st ORDER BY {column} DESC, k LIMIT 20", LOG, RAW_STATS)
    add(f"top_templates_by_{mode}_ascending", f"SELECT {_STATS} FROM st ORDER BY {column}, k LIMIT 20", LOG, RAW_STATS)
add("flagship", f"SELECT {_STATS} FROM st ORDER BY total DESC, k LIMIT 20", *BASE, ALL_STATS)
PROBLEMS = """
problems AS (
  SELECT 'N+1' AS kind, normalized_query AS query, count(*) AS n, CAST(NULL AS BIGINT) AS avg_us
    FROM ev WHERE n_plus_1 GROUP BY 2
  UNION ALL
  SELECT 'SLOW', normalized_query, count(*), CAST(sum(dur_us) AS BIGINT) // count(*) FROM ev WHERE slow_query GROUP BY 2)
"""
for name in ("ci_problems", "stream_ci_gate"):
    add(name, "SELECT kind, query, n, avg_us FROM problems", *FLAGGED, PROBLEMS)
_SUMMARY = "(SELECT count(*) FROM ev) AS total, count(*) AS problems, count(*) > 0 AS has_problems"
add(
    "ci_summary",
    f"SELECT {_SUMMARY}, CASE WHEN count(*) > 0 THEN 1 ELSE 0 END AS exit_code FROM problems",
    *FLAGGED,
    PROBLEMS,
)
_AVG = duration_text("(avg_us // 1000 * 1000000)")
_NONE = "'' AS kind, CAST(0 AS BIGINT) AS n, '' AS query"
add(
    "ci_report",
    f"""SELECT 0 AS section, {_NONE}, {q(REPORT_TITLE)} AS line
    UNION ALL SELECT 1, {_NONE}, concat('Captured: ', CAST(total AS VARCHAR), ' queries') FROM su
    UNION ALL SELECT 2, {_NONE}, CASE WHEN has_problems THEN 'Problems found:' ELSE 'No problems found.' END FROM su
    UNION ALL SELECT 3, kind, n, query, CASE WHEN kind = 'N+1'
        THEN concat('  [N+1]  ', query, '  (detected ', CAST(n AS VARCHAR), ' times)')
        ELSE concat('  [SLOW] ', query, '  (avg ', {_AVG}, ', ', CAST(n AS VARCHAR), ' occurrences)') END FROM problems
    UNION ALL SELECT 4, {_NONE}, concat('Exit: 1 (', CAST(problems AS VARCHAR), ' problems found)') FROM su
      WHERE has_problems""",
    *FLAGGED,
    PROBLEMS,
    f"su AS (SELECT {_SUMMARY} FROM problems)",
)
ORACLES["stream_ci_verdict"], ORACLES["stream_ci_report"] = ORACLES["ci_summary"], ORACLES["ci_report"]
_INSERTS = "regexp_matches(query, '(?i)^[[:space:]]*insert') AND contains(lower(query), 'orders')"
add(
    "export_summary",
    f"""SELECT (SELECT count(*) FROM log) AS captured, count(*) AS exported, 'op:insert' AS filter, 'orders' AS search,
      {clock('min_by(start_us, seq)', False)} AS period_start, {clock('max_by(start_us, seq)', False)} AS period_end
      FROM log WHERE {_INSERTS}""",
)

# Transactions and listings
TX_SUMMARY = """
SELECT tx_id, count(*) FILTER (WHERE op IN (0, 1, 4)) AS n_queries,
  count(*) FILTER (WHERE op NOT IN (2, 3, 5, 6, 7)) AS n_not_lifecycle, count(*) AS n_events,
  min_by(start_us, seq) AS start_us, max_by(start_us + dur_us, seq) - min_by(start_us, seq) AS wall_us
FROM tx WHERE tx_id IS NOT NULL GROUP BY tx_id
"""
add("tx_summary", TX_SUMMARY, *LABELLED)
LISTING = """
anchors AS (SELECT tx_id, min(seq) AS anchor FROM tx WHERE op = 5 AND tx_id IS NOT NULL GROUP BY 1),
shown AS (SELECT coalesce(anchor, seq) AS anchor, 1 AS kind, seq, tx_id FROM tx LEFT JOIN anchors USING (tx_id)),
heads AS (SELECT anchor, 0 AS kind, anchor AS seq, tx_id FROM anchors)
"""
add("tx_listing", "SELECT * FROM shown UNION ALL SELECT * FROM heads", *LABELLED, LISTING)
add(
    "tx_listing_collapsed",
    """SELECT * FROM shown WHERE tx_id IS NULL OR tx_id NOT IN (SELECT tx_id FROM tx WHERE error <> '' AND tx_id IS NOT NULL)
    UNION ALL SELECT * FROM heads""",
    *LABELLED,
    LISTING,
)
add("flat_by_duration", "SELECT seq, dur_us FROM log ORDER BY dur_us DESC, seq LIMIT 100")


def tx_lines(preview: bool) -> str:
    short = "CASE WHEN length(flat) <= 40 THEN flat ELSE concat(substr(flat, 1, 39), '…') END"
    line = f"concat('  ', rpad({op_name('op')}, 8, ' '), ' ', CASE WHEN flat = '' THEN '-' ELSE {short} END"
    line += ")" if preview else f", ' ', {format_us('dur_us')})"
    where = " AND op IN (0, 1, 4)" if preview else ""
    named = "CASE WHEN n_queries = 1 THEN '1 query' ELSE concat(CAST(n_queries AS VARCHAR), ' queries') END"
    head = [
        "'Type:     Transaction'",
        f"concat('Queries:  ', {named})",
        f"concat('Duration: ', {format_us('wall_us')})",
        f"concat('Time:     ', {clock('start_us', False)})",
        "concat('Tx:       ', tx_id)",
    ]
    parts = [
        f"SELECT tx_id, {i} AS section, CAST(-1 AS BIGINT) AS seq, {text} AS line FROM sm" for i, text in enumerate(head)
    ]
    parts.append(
        f"SELECT tx_id, 5, seq, {line} FROM (SELECT *, trim(regexp_replace(query, '[[:space:]]+', ' ', 'g')) AS flat FROM tx)"
        f" WHERE tx_id IS NOT NULL{where}"
    )
    return "\nUNION ALL ".join(parts)


add("tx_detail", tx_lines(False), *LABELLED, f"sm AS ({TX_SUMMARY})")
add("tx_preview", tx_lines(True), *LABELLED, f"sm AS ({TX_SUMMARY})")
add(
    "event_detail",
    f"""SELECT seq, {op_name('op')} AS op, query, CASE WHEN len(args) > 0 THEN concat('[', array_to_string(args, ', '), ']') END
      AS args, {format_us('dur_us')} AS duration, {clock('start_us', False)} AS time,
      CASE WHEN rows_affected > 0 THEN rows_affected END AS rows_affected, error, tx_id FROM tx WHERE error <> ''""",
    *LABELLED,
)

# Timeline
BARS = "bars AS (SELECT * FROM log WHERE op IN (0, 1, 4))"
BOUNDS = """
bounds AS (SELECT min(start_us) AS min_us, max(start_us + dur_us) AS max_us, count(*) AS n,
  greatest((max(start_us + dur_us) - min(start_us)) // 1000, 1) AS span_ms FROM bars)
"""
add("timeline_bounds", "SELECT * FROM bounds", LOG, BARS, BOUNDS)
add(
    "timeline_last_n",
    "SELECT * FROM bounds",
    LOG,
    "bars AS (SELECT * FROM log WHERE op IN (0, 1, 4) ORDER BY seq DESC LIMIT 500)",
    BOUNDS,
)
add(
    "timeline_layout",
    """SELECT seq, round(f, 6) AS start_frac, round(d, 6) AS dur_frac, CAST(floor(f * 80) AS BIGINT) AS bar_start,
      least(CAST(floor(f * 80) AS BIGINT) + greatest(CAST(ceil(d * 80) AS BIGINT), 1), 80) AS bar_end
    FROM (SELECT seq, ((start_us - min_us) // 1000) / CAST(span_ms AS DOUBLE) AS f,
      (dur_us // 1000) / CAST(span_ms AS DOUBLE) AS d FROM bars, bounds)""",
    LOG,
    BARS,
    BOUNDS,
)
add(
    "timeline_layout_web",
    """SELECT seq, round(360 + (ms - lo) / span * 1000, 6) AS x, round(greatest(d / span * 1000, 2.0), 6) AS w
    FROM (SELECT seq, start_us // 1000 AS ms, dur_us / 1000.0::DOUBLE AS d FROM bars),
      (SELECT lo, greatest(hi - lo, 1.0::DOUBLE) AS span FROM (SELECT min(start_us // 1000) AS lo,
        max(start_us // 1000 + dur_us / 1000.0::DOUBLE) AS hi FROM bars))""",
    LOG,
    BARS,
)
add(
    "timeline_ticks",
    f"""SELECT tick, round(ms, 6) AS tick_ms, col, {format_us('(CAST(floor(ms * 1000) AS BIGINT))')} AS label FROM (
      SELECT CAST(i AS INTEGER) AS tick, i / 6.0::DOUBLE * CAST(span_ms AS DOUBLE) AS ms,
        CAST(floor(i / 6.0::DOUBLE * 79) AS BIGINT) AS col FROM bounds, range(7) t(i))""",
    LOG,
    BARS,
    BOUNDS,
)
add(
    "timeline_ticks_web",
    f"""SELECT tick, round(ms, 6) AS tick_ms, round(col, 6) AS col, {format_ms('ms', True)} AS label FROM (
      SELECT CAST(i AS INTEGER) AS tick, i / 10.0::DOUBLE * CAST(span_ms AS DOUBLE) AS ms,
        i / 10.0::DOUBLE * 1000 AS col FROM bounds, range(11) t(i))""",
    LOG,
    BARS,
    BOUNDS,
)
# Overlaps are counted bar by bar, not from changes.
_SPANS = "spans AS (SELECT seq, start_us // 10000 AS lo, (start_us + dur_us) // 10000 AS hi FROM bars)"
add(
    "timeline_concurrency",
    """SELECT bucket, lead(bucket) OVER (ORDER BY bucket) AS until, running FROM (
      SELECT bucket, count(spans.seq) AS running
      FROM (SELECT lo AS bucket FROM spans UNION SELECT hi + 1 FROM spans) LEFT JOIN spans ON lo <= bucket AND hi >= bucket GROUP BY 1)""",
    LOG,
    BARS,
    _SPANS,
)
add(
    "timeline_running_at",
    """SELECT bucket, count(spans.seq) AS running FROM (
      SELECT unnest(range((SELECT min(lo) FROM spans), (SELECT max(hi) + 8 FROM spans), 7)) AS bucket)
    LEFT JOIN spans ON lo <= bucket AND hi >= bucket GROUP BY 1""",
    LOG,
    BARS,
    _SPANS,
)
add(
    "timeline_peaks",
    """SELECT bucket // 100 AS cell, max(n) AS peak, CAST(sum(n) AS BIGINT) AS busy
    FROM (SELECT bucket, count(*) AS n FROM (SELECT unnest(range(lo, hi + 1)) AS bucket FROM spans) GROUP BY 1) GROUP BY 1""",
    LOG,
    BARS,
    _SPANS,
)

# Text functions
_SCALED = "(dur_us * CASE WHEN seq % 3 = 0 THEN 37 ELSE 1 END)"
add(
    "format_duration",
    f"SELECT seq, {format_us(_SCALED)} AS duration, {format_ms(_SCALED + ' / 1000.0::DOUBLE')} AS duration_ms FROM log",
)
add(
    "duration_text",
    f"SELECT seq, {duration_text('(dur_us * CASE WHEN seq % 2 = 0 THEN 1000 ELSE 25000000 END)')} AS duration FROM log",
)
add("format_time", f"SELECT seq, {clock('start_us')} AS time, {clock('start_us', False)} AS time_full FROM log")
_FLAT = "trim(regexp_replace(text, '[\\t\\n\\f\\r ]+', ' ', 'g'))"
add(
    "squash_truncate",
    f"""SELECT doc_id, CASE WHEN length(flat) <= 60 THEN flat ELSE concat(substr(flat, 1, 59), '…') END AS short,
      md5(flat) AS squashed FROM (SELECT doc_id, {_FLAT} AS flat FROM documents)""",
    "one AS (SELECT 1)",
)
add(
    "truncate_dots",
    "SELECT seq, CASE WHEN length(query) <= 30 THEN query ELSE concat(substr(query, 1, 27), '...') END AS short FROM log",
)
add("escape_pipes", "SELECT seq, replace(error, '|', concat(chr(92), '|')) AS error FROM log")
add("format_args", f"SELECT seq, {SHOWN_ARGS} AS args FROM log")
_CUT = "(start_us - CASE seq % 3 WHEN 0 THEN start_us % 1000000 WHEN 1 THEN start_us % 1000 ELSE 0 END)"
add("rfc3339_time", f"SELECT seq, {rfc3339(_CUT)} AS time FROM log")

# Streams
add("stream_enrich", "SELECT seq, normalized_query, slow_query FROM tpl", *BASE)
add("stream_nplus1", "SELECT key, start_us, seq, cnt >= 5 AS n_plus_1, cnt FROM counted", *FLAGGED)
ORACLES["stream_nplus1_alerts"] = ORACLES["nplus1_alerts"]
ORACLES["stream_alert_feed"] = ORACLES["alert_feed"]
add("stream_nplus1_off", "SELECT key, start_us, seq, false AS n_plus_1, cnt FROM counted", *FLAGGED)
add(
    "stream_template_stats",
    """SELECT normalized_query, count(*) AS n, CAST(sum(dur_us) AS BIGINT) AS total_us, CAST(sum(dur_us) // count(*) AS BIGINT) AS avg_us,
      max(dur_us) AS max_us, true AS p95_near
    FROM tpl WHERE op NOT IN (2, 3, 5, 6, 7) AND normalized_query <> '' GROUP BY 1""",
    *BASE,
)
_RATES = """SELECT window_us, normalized_query, count(*) AS n, count(*) FILTER (WHERE error <> '') AS errors,
  count(*) FILTER (WHERE slow_query) AS slow, window_us + 1000000 <= (SELECT max(start_us) FROM tpl) - 1000000 AS closed FROM w GROUP BY 1, 2"""
add("stream_windowed_rates", _RATES, *BASE, "w AS (SELECT *, start_us // 1000000 * 1000000 AS window_us FROM tpl)")
add(
    "stream_sliding_rates",
    _RATES,
    *BASE,
    "w AS (SELECT tpl.*, start_us // 200000 * 200000 - i * 200000 AS window_us FROM tpl, range(5) t(i))",
)
add(
    "stream_tx_summary",
    f"""SELECT s.*, CASE WHEN tx_id IN (SELECT tx_id FROM tx WHERE op IN (6, 7)) THEN 'closed'
        WHEN tx_id IN (SELECT max_by(tx_id, seq) FROM tx WHERE op IN (5, 6, 7) GROUP BY conn_id) THEN 'open' ELSE 'replaced' END AS state
    FROM ({TX_SUMMARY}) s""",
    *LABELLED,
)

# The stream takes the log in four slices by arrival; the watermark of a slice comes from the slices before it.
add(
    "late_event_report",
    """SELECT normalized_query, count(*) FILTER (WHERE shown_us < mark) AS late, count(*) AS seen
    FROM sliced LEFT JOIN marks USING (slice) GROUP BY 1""",
    *BASE,
    """sliced AS (SELECT *, (seq - lo) // ((hi - lo) // 4 + 1) AS slice FROM (
      SELECT *, start_us - CASE WHEN error <> '' THEN 200000000 ELSE 0 END AS shown_us,
        min(seq) OVER () AS lo, max(seq) OVER () AS hi FROM tpl))""",
    """marks AS (SELECT slice, (max(top) OVER (ORDER BY slice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
      // 1000 - 1000) * 1000 AS mark FROM (SELECT slice, max(shown_us) AS top FROM sliced GROUP BY 1))""",
)

# Text libraries
_STRING = q("'(?:[^']|'')*'?")
_BARE = f"regexp_replace(query, {_STRING}, {q(chr(39) * 2)}, 'g')"


def _list(words: tuple[str, ...]) -> str:
    return "(" + ", ".join(map(q, words)) + ")"


# The queries of this log hold numbers only after a space or at the end, so words and signs can be split off simply.
add(
    "sql_token_census",
    f"""SELECT normalized_query, kind, count(*) AS n FROM (
      SELECT normalized_query, CASE WHEN t LIKE '$%' OR t = '?' THEN 'parameter' WHEN regexp_matches(t, '^[0-9]') THEN 'number'
        WHEN upper(t) IN {_list(KEYWORDS)} THEN 'keyword' WHEN upper(t) IN {_list(FUNCTIONS)} THEN 'function' END AS kind
      FROM (SELECT normalized_query, unnest(regexp_extract_all({_BARE}, '[$][0-9]+|[?]|[A-Za-z_][A-Za-z0-9_]*|[0-9][0-9.]*'))
        AS t FROM tpl)
      UNION ALL
      SELECT normalized_query, 'string' FROM (SELECT normalized_query,
        unnest(regexp_extract_all(query, {_STRING})) FROM tpl)) WHERE kind IS NOT NULL GROUP BY 1, 2""",
    *BASE,
)
_METRICS = q(rf"\((?:{'|'.join(MEASURES)})[^)]*\)")
add(
    "plan_node_census",
    f"""SELECT kind, name, count(*) AS n FROM (
      SELECT 'summary' AS kind, lower(summary) AS name FROM l WHERE summary <> ''
      UNION ALL SELECT 'metrics', '' FROM l WHERE summary = '' AND regexp_matches(line, {_METRICS})
      UNION ALL SELECT 'node', lower(unnest(regexp_extract_all(regexp_replace(line, {_METRICS}, '', 'g'),
        {q(chr(92) + 'b(?i:' + '|'.join(PLAN_NODES) + ')' + chr(92) + 'b')}))) FROM l WHERE summary = '') GROUP BY 1, 2""",
    PLANS_DUCKDB,
    f"""l AS (SELECT line, regexp_extract(line, '(?i)^[[:space:]]*({'|'.join(SUMMARY_LINES)}):', 1) AS summary
      FROM (SELECT unnest(string_split(plan, chr(10))) AS line FROM plans))""",
)
