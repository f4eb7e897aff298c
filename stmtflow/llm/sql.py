"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from stmtflow.llm import url_templates as ut
from stmtflow.llm.licenses import MASS, TEMPLATES
from stmtflow.llm import sharding as sh
from stmtflow.llm import trie_codes as tc
from stmtflow.llm.mixing import MOST, SEED, SHARE_PERCENT, WEIGHTS

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLES: dict[str, str] = {}

ORACLES["op8_warc_index"] = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages
), q AS (
  SELECT *, max(page_id) OVER (PARTITION BY hex) AS last FROM p
)
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(((('0x' || substr(hex, CAST(5 * (i // 4) + 1 AS BIGINT), 5))::BIGINT >> CAST(5 * (3 - i % 4) AS BIGINT)) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to
FROM q
"""

ORACLES["op9_mix_sources"] = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    CAST([{", ".join(map(str, WEIGHTS))}][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1 AS BIGINT)] AS BIGINT) AS w
  FROM d GROUP BY source
), r AS (
  SELECT *, {MOST} * source_size AS c,
    coalesce(sum({MOST} * source_size) OVER before, 0) AS taken,
    sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS rest,
    sum(source_size) OVER () * {SHARE_PERCENT} AS amount
  FROM s WINDOW before AS (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), v AS (
  SELECT CAST(amount - 100 * taken AS DOUBLE) / CAST(100 * rest AS DOUBLE) AS level FROM r
  WHERE CAST(amount - 100 * taken AS DOUBLE) / CAST(100 * rest AS DOUBLE) <= c / w
  ORDER BY source_size / w, source NULLS LAST LIMIT 1
), t AS (
  SELECT source, source_size, least(CAST(c AS DOUBLE), (SELECT level FROM v) * w) AS target FROM r
)
SELECT doc_id, size, source_size, target,
  CAST(size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
    ('0x' || substr(md5('{SEED}:' || doc_id), 1, 8))::BIGINT / 4294967296.0 AS draw
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
"""

_TEMPLATES = ", ".join(
    f"('{t.name}', '{t.label}', {str(t.base).lower()}, [{', '.join(repr(k) for k in t.keys)}]::VARCHAR[], {o}, '{w}')"
    for t in TEMPLATES
    for o, w in t.postings()
)

ORACLES["op4_license_scan"] = rf"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents
), tp AS (
  SELECT * FROM (VALUES {_TEMPLATES}) AS t(name, label, base, keys, o, word)
), tok AS (
  SELECT r, unnest(words) AS word, unnest(range(len(words))) AS pos FROM d
), p AS (
  SELECT * FROM tok WHERE word IN (SELECT word FROM tp)
), idf AS (
  SELECT v.word, ln((1 + (SELECT count(*) FROM d)) / (1.0 + count(DISTINCT r))) + 1 AS idf
  FROM (SELECT DISTINCT word FROM tp) v LEFT JOIN p USING (word) GROUP BY v.word
), tm AS (
  SELECT tp.*, idf, idf / sum(idf) OVER (PARTITION BY name) AS mass, count(*) OVER (PARTITION BY name) AS need FROM tp JOIN idf USING (word)
), naming AS (
  SELECT name, word FROM (
    SELECT name, word, base, row_number() OVER rarest AS nth, coalesce(sum(mass) OVER (rarest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
    FROM (SELECT name, word, base, idf, sum(mass) AS mass FROM tm GROUP BY ALL) WINDOW rarest AS (PARTITION BY name ORDER BY idf DESC, word DESC))
  WHERE nth = 1 OR NOT base AND round(ahead, 9) <= round(1 - {MASS}, 9)
), votes AS (
  SELECT r, name, any_value(label) AS label, any_value(base) AS base, any_value(keys) AS keys, pos - o AS start, count(*) AS found, sum(mass) AS share, any_value(need) AS need
  FROM p JOIN tm USING (word)
  WHERE EXISTS (SELECT 1 FROM p AS a JOIN naming n ON n.word = a.word WHERE a.r = p.r AND n.name = tm.name)
  GROUP BY r, name, pos - o
), fits AS (
  SELECT *, CASE WHEN base THEN found = need ELSE share >= {MASS} END AS fit FROM votes
), byd AS (
  SELECT r, count(*) FILTER (fit AND base) AS n_base, min(start) FILTER (fit AND base) AS first_word, max(start) FILTER (fit AND base) AS last_word,
    list(DISTINCT name) FILTER (fit) AS names, max(least(round(share, 6), 1.0)) AS score,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (fit AND base) AS base_labels
  FROM fits GROUP BY r
), labels AS (
  SELECT f.r, string_agg(DISTINCT f.label, ',' ORDER BY f.label) AS labels
  FROM fits f JOIN byd USING (r) WHERE fit AND list_has_all(byd.names, f.keys) GROUP BY f.r
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN byd USING (r) LEFT JOIN labels USING (r)
"""

ORACLES["op7_near_duplicates"] = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' '))) END AS sh FROM d
), u AS (
  SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s
), links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM u AS a JOIN u AS b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id, doc_id AS other FROM d UNION SELECT r.doc_id, l.y FROM reach AS r JOIN links AS l ON l.x = r.other
), c AS (
  SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
)
SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c USING (doc_id)
"""

ORACLES["op3_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT * FROM r WHERE rank <= 20
"""

_RULES = sorted(ut.RULES, key=lambda r: -len(r[0] + r[1]))


def _by_rule(value: int | None) -> str:
    """CASE over the rules, longest first: the rule itself or one of its fields."""
    whens = (
        f"WHEN (host = '{r[0]}' OR ends_with(host, '.{r[0]}')) AND starts_with(path, '{r[1]}') THEN '{r[0] + r[1] if value is None else r[value]}'"
        for r in _RULES
    )
    return "CASE " + " ".join(whens) + " END"


#: Levels that the SQL follows: wildcards and merges deeper than this many segments are the operator's alone.
URL_LEVELS = 6


def _url_sql() -> str:
    steps = [
        rf"""p AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN url ELSE '' END AS u FROM pages
), h AS (
  SELECT page_id, translate(coalesce(regexp_extract(u, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
    coalesce(regexp_extract(u, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM p
), s AS (
  SELECT *, row_number() OVER () AS row, {_by_rule(None)} AS rule, {_by_rule(2)} AS said FROM h
), t0 AS (
  SELECT row, host, list_transform(string_split(path, '/'), lambda x: regexp_replace(x, '^[0-9]+([.][A-Za-z0-9]+)?$', '{{n}}\1')) AS segs FROM s
)"""
    ]
    for i in range(1, URL_LEVELS + 1):
        steps.append(
            f"""wild{i} AS MATERIALIZED (
  SELECT host, parent, seg FROM (SELECT *, count(*) OVER w AS kinds, sum(n) OVER w AS total FROM (
    SELECT host, segs[1 : {i - 1}] AS parent, segs[{i}] AS seg, count(*) AS n FROM t{i - 1} WHERE len(segs) >= {i} GROUP BY ALL)
    WINDOW w AS (PARTITION BY host, parent))
  WHERE kinds > {ut.WIDE} AND n < {ut.RARE_SHARE} * total AND NOT starts_with(seg, '{{')
), t{i} AS MATERIALIZED (
  SELECT row, t.host, CASE WHEN w.seg IS NULL THEN segs ELSE list_concat(segs[1 : {i - 1}], ['{{*}}'], segs[{i + 1} :]) END AS segs
  FROM t{i - 1} t LEFT JOIN wild{i} w ON t.host = w.host AND len(segs) >= {i} AND segs[1 : {i - 1}] = w.parent AND segs[{i}] = w.seg
)"""
        )
    steps.append(
        f"""t AS (SELECT row, array_to_string(segs, '/') AS template FROM t{URL_LEVELS}
), c AS MATERIALIZED (
  SELECT host, template, count(*) FILTER (said = 'block') AS b, count(said) AS l FROM s JOIN t USING (row) GROUP BY ALL
), m0 AS (SELECT *, string_split(template, '/') AS segs FROM c)"""
    )
    for i in range(1, URL_LEVELS + 1):
        steps.append(
            f"""kids{i} AS MATERIALIZED (
  SELECT host, segs[1 : {i - 1}] AS parent, segs[{i}] AS seg, CAST(sum(b) AS BIGINT) AS b, CAST(sum(l) AS BIGINT) AS l
  FROM m{i - 1} WHERE len(segs) >= {i} AND NOT starts_with(segs[{i}], '{{') GROUP BY ALL
), near{i} AS MATERIALIZED (
  SELECT host, parent, seg, sum(CASE WHEN pb IS NULL OR CAST((b * pl - pb * l) * (b * pl - pb * l) * (l + pl) AS DOUBLE)
      > {ut.CHI_SQUARE}::DOUBLE * CAST((b + pb) * (l + pl - b - pb) * l * pl AS DOUBLE) THEN 1 ELSE 0 END)
    OVER (PARTITION BY host, parent ORDER BY share, seg ROWS UNBOUNDED PRECEDING) AS branch
  FROM (SELECT *, b / l AS share, lag(b) OVER w AS pb, lag(l) OVER w AS pl FROM kids{i} WHERE l > 0 WINDOW w AS (PARTITION BY host, parent ORDER BY b / l, seg))
), same{i} AS MATERIALIZED (
  SELECT host, parent, seg, branch FROM (SELECT *, count(*) OVER (PARTITION BY host, parent, branch) AS size FROM (
    FROM near{i} UNION ALL SELECT k.host, k.parent, k.seg, 1 FROM kids{i} k
      JOIN (SELECT host, parent FROM near{i} GROUP BY ALL HAVING max(branch) = 1) o ON k.host = o.host AND k.parent = o.parent WHERE k.l = 0))
  WHERE size > 1
), m{i} AS MATERIALIZED (
  SELECT m.host, template, b, l, CASE WHEN w.seg IS NULL THEN segs
    ELSE list_concat(segs[1 : {i - 1}], ['{{=' || CAST(branch AS VARCHAR) || '}}'], segs[{i + 1} :]) END AS segs
  FROM m{i - 1} m LEFT JOIN same{i} w ON m.host = w.host AND len(segs) >= {i} AND segs[1 : {i - 1}] = w.parent AND segs[{i}] = w.seg
)"""
        )
    return f"""WITH {", ".join(steps)}, prior AS (
  SELECT (sum(b) + 1) / (sum(l) + 2) AS base FROM c
), shapes AS (
  SELECT template, (sum(b) + {ut.STRENGTH} * any_value(base)) / (sum(l) + {ut.STRENGTH}) AS shape FROM c, prior GROUP BY template
), g AS (
  SELECT host, template, sum(b) OVER w AS b, sum(l) OVER w AS l FROM m{URL_LEVELS} WINDOW w AS (PARTITION BY host, segs)
), v AS (
  SELECT host, template, CASE WHEN l > 0 AND (b - l * shape) * (b - l * shape) > {ut.CHI_SQUARE} * (l * shape) * (1 - shape)
    THEN (b + {ut.STRENGTH} * shape) / (l + {ut.STRENGTH}) ELSE shape END AS impurity FROM g JOIN shapes USING (template)
)
SELECT page_id, s.host, path, rule, coalesce(said, CASE WHEN impurity >= {ut.REJECT} THEN 'block' ELSE 'allow' END) AS verdict, template
FROM s JOIN t USING (row) JOIN v USING (host, template)"""


ORACLES["op1_url_templates"] = _url_sql()

# The heap is a list of loads; CRC-32 is worked out byte by byte, its table by the polynomial's rule.
ORACLES["op11_shards"] = rf"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), d AS (
  SELECT doc_id, coalesce(text, '') AS body, strlen(coalesce(text, '')) + {sh.ROW_BYTES} AS size, sha256(coalesce(text, '')) AS h FROM documents
), checked AS (
  SELECT DISTINCT h, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(body)), '..'), lambda b: ('0x' || b)::BIGINT)),
    lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) AS crc32 FROM d, crc
), grain AS (
  SELECT greatest(1, sum(size) // ({sh.SHARDS} * {sh.PIECES})) AS grain FROM d
), g AS (
  SELECT h, CAST(sum(size) AS BIGINT) AS bytes FROM d GROUP BY h
), placed AS (
  SELECT h, bytes, CASE WHEN bytes <= grain THEN ('0x' || substr(h, 1, {sh.DIGITS}))::INTEGER END AS bucket, grain FROM g, grain
), bound AS (
  SELECT h, bytes, bucket, CASE WHEN bucket IS NOT NULL THEN coalesce(sum(bytes) OVER (PARTITION BY bucket ORDER BY bytes DESC, h
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // grain END AS bundle FROM placed
), items AS (
  SELECT bucket, bundle, h, bytes FROM bound WHERE bucket IS NULL
  UNION ALL SELECT bucket, bundle, NULL, CAST(sum(bytes) AS BIGINT) FROM bound WHERE bucket IS NOT NULL GROUP BY bucket, bundle
), queue AS (
  SELECT *, row_number() OVER (ORDER BY bytes DESC, bucket NULLS FIRST, bundle, h) AS r FROM items
), lpt AS (
  SELECT 0::BIGINT AS r, list_transform(range({sh.SHARDS}), lambda i: 0::BIGINT) AS loads, NULL::BIGINT AS shard
  UNION ALL
  SELECT q.r, list_transform(loads, lambda x, i: CASE WHEN i = list_position(loads, list_min(loads)) THEN x + q.bytes ELSE x END),
    list_position(loads, list_min(loads)) - 1
  FROM lpt JOIN queue q ON q.r = lpt.r + 1
), dealt AS (
  SELECT q.bucket, q.bundle, q.h, CAST(shard AS INTEGER) AS shard FROM lpt JOIN queue q USING (r)
), grouped AS (
  SELECT b.h, x.shard FROM bound b JOIN dealt x ON b.bucket IS NULL AND b.h = x.h OR b.bucket = x.bucket AND b.bundle = x.bundle
)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(crc32 AS BIGINT) AS text_crc32, '{sh.LAW}' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id, h) - 1 AS slot, NULL::INTEGER AS grown_shard
FROM d JOIN grouped USING (h) JOIN checked USING (h)
"""


def _codes_sql() -> str:
    """Plain assignment of every part of every vector, round by round."""
    steps = [
        f"""v AS (
  SELECT vec_id, label, list_transform(embedding, lambda c: CAST(floor(c::DOUBLE * {tc.SCALE}) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
)""",
        f"w AS (SELECT max(len(x)) // {tc.PARTS} AS w FROM v)",
        f"p AS (SELECT vec_id, label, i AS pos, x[CAST(i * w + 1 AS BIGINT) : CAST((i + 1) * w AS BIGINT)] AS part FROM v, w, range({tc.PARTS}) t(i))",
        f"book0 AS (SELECT pos, row_number() OVER (PARTITION BY pos ORDER BY vec_id) - 1 AS entry, part AS c FROM p"
        f" QUALIFY row_number() OVER (PARTITION BY pos ORDER BY vec_id) <= {tc.ENTRIES})",
    ]
    for r in range(tc.ROUNDS + 1):
        steps.append(
            f"""near{r} AS MATERIALIZED (
  SELECT vec_id, label, pos, part, entry, err FROM (SELECT p.*, entry,
    list_sum(list_transform(list_zip(part, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS err FROM p JOIN book{r} USING (pos))
  QUALIFY row_number() OVER (PARTITION BY vec_id, pos ORDER BY err, entry) = 1
)"""
        )
        if r < tc.ROUNDS:
            steps.append(
                f"""book{r + 1} AS MATERIALIZED (
  SELECT b.pos, b.entry, coalesce(m.c, b.c) AS c FROM book{r} b LEFT JOIN (
    SELECT pos, entry, list(mean ORDER BY k) AS c FROM (
      SELECT pos, entry, k, CAST(floor(sum(part[CAST(k + 1 AS BIGINT)])::HUGEINT / count(*)) AS BIGINT) AS mean FROM near{r}, w, range(w) t(k) GROUP BY ALL)
    GROUP BY ALL) m USING (pos, entry)
)"""
            )
    last = tc.ROUNDS
    return f"""WITH {", ".join(steps)}, coded AS (
  SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', CAST(entry AS INTEGER)), '' ORDER BY pos) AS code, CAST(sum(err) AS BIGINT) AS error
  FROM near{last} GROUP BY vec_id
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY pos, entry)) FROM book{last}) AS codebooks_sha256
FROM coded"""


ORACLES["op13_vector_codes"] = _codes_sql()
