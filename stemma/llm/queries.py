"""The queries of this folder's operators: one op<N>_<name> each, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import secrets

    return secrets.digests(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op3_edit_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import edit_fingerprint

    return edit_fingerprint.against_edits(table(spark, sf_dir, "documents"))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import mixing

    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import piece_bpe

    return piece_bpe.encode(table(spark, sf_dir, "documents"), tokenizer_path(), digests=True)


def op6_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import substring_dedup

    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), texts=False)


def op7_vector_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import vector_graph

    return vector_graph.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import html_crf

    return html_crf.extract(table(spark, sf_dir, "pages"))


def op9_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import minmax

    return minmax.near_duplicates(table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import radix_dedup

    return radix_dedup.remove_repeats(table(spark, sf_dir, "documents"), texts=False)


def op11_two_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import packing

    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import turns

    rows = table(spark, sf_dir, "conversations")
    return turns.audit(turns.damaged(rows), ids=rows)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import periodic

    return periodic.detect(table(spark, sf_dir, "documents"), digests=True, change=periodic.planted)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_toxicity": op2_toxicity,
    "op3_edit_fingerprint": op3_edit_fingerprint,
    "op4_source_mix": op4_source_mix,
    "op5_piece_bpe": op5_piece_bpe,
    "op6_window_dedup": op6_window_dedup,
    "op7_vector_near_dedup": op7_vector_near_dedup,
    "op8_page_text": op8_page_text,
    "op9_minmax_near_dedup": op9_minmax_near_dedup,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_two_fit_packing": op11_two_fit_packing,
    "op12_turn_repair": op12_turn_repair,
    "op13_periodic_runs": op13_periodic_runs,
}

_WORDS = r"list_filter(regexp_split_to_array({0}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_CRC32 = "xor(4294967295, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split({0}, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda x, b: list_reduce(list_concat([xor(x, b)], [CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0]), lambda y, z: CASE WHEN y % 2 = 1 THEN xor(y // 2, 3988292384) ELSE y // 2 END)))"


def _turn_steps() -> str:
    """b0 to b3: the cheapest (cost, edits, text) from a row on, by the state before it, made of those behind it."""
    due, name = {0: 2, 1: 2, 2: 3, 3: 2}, {2: "user", 3: "assistant"}
    keeps = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    made = lambda cost, edit, text, then: f"struct_pack(c := b{then}.c + {cost}, e := '{edit}' || b{then}.e, t := {text}b{then}.t)"

    def own(k: int) -> list[str]:
        kept = " ".join(f"WHEN keeps = '{initial}' THEN {made('more', 'K', 'body || ', then)}" for initial, then in keeps[k].items())
        return [made(4, "D", "", k), f"CASE WHEN NOT gone THEN {made('3 + more', 'R', f"'{name[due[k]]}:' || text || chr(10) || ", due[k])} END", f"CASE WHEN gone THEN NULL {kept} END"]

    best = [f"list_min([{', '.join(own(k))}])" for k in range(4)]
    put = lambda k, cost, edits, text: f"struct_pack(c := g{k}.c + {cost}, e := '{edits}' || g{k}.e, t := {text} || g{k}.t)"
    line = {k: f"'{name[due[k]]}:' || chr(10)" for k in range(4)}
    full = [f"list_min([g{k}, {put(due[k], 3, 'I', line[k])}, {put(due[due[k]], 6, 'II', f'{line[k]} || {line[due[k]]}')}]) AS b{k}" for k in range(4)]
    return f"SELECT conv_id, k - 1 AS k, {', '.join(full)} FROM (SELECT conv_id, k, {', '.join(f'{b} AS g{k}' for k, b in enumerate(best))} FROM (SELECT b.*, gone, more, keeps, text, body FROM b JOIN f ON f.conv_id = b.conv_id AND f.k = b.k))"


#: Plain restatements by grouping all windows, strings, shingles or equal words, and row by row from the last; the others have no SQL form.
ORACLE_SQL: dict[str, str] = {
    "op6_window_dedup": f"""
WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM d WHERE len(ws) >= 13)),
first AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
gone AS (SELECT DISTINCT win.doc_id, i + j AS p FROM win JOIN first ON first.k = win.k AND m < win.doc_id, range(13) r(j)),
words AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM d),
left_ AS (SELECT words.doc_id, count(gone.p) AS n, string_agg(w, ' ' ORDER BY words.p) FILTER (gone.p IS NULL) AS kept FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.p = words.p GROUP BY 1)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN left_ ON left_.doc_id = d.doc_id""",
    "op9_minmax_near_dedup": f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')")} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 3))) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
l AS (SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON b.k = a.k AND a.doc_id <> b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id GROUP BY ALL HAVING 100 * count(*) >= 75 * (any_value(na.n) + any_value(nb.n) - count(*))),
c AS (SELECT doc_id, doc_id AS r FROM d UNION SELECT c.doc_id, l.y FROM c JOIN l ON l.x = c.r),
m AS (SELECT doc_id, min(r) AS component_id FROM c GROUP BY 1)
SELECT m.doc_id, coalesce(n, 0) AS n_shingles, component_id, component_id = m.doc_id AS kept FROM m LEFT JOIN n ON n.doc_id = m.doc_id""",
    "op10_suffix_dedup": """
WITH h AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents),
part AS (SELECT doc_id, p, substring(h, 2 * p + 1, 2 * (1000 + 49)) AS h FROM (SELECT doc_id, h, unnest(range(0, n, 1000)) AS p FROM h)),
win AS (SELECT doc_id, p + i AS i, md5_number(substring(h, 2 * i - 1, 100)) AS k FROM (SELECT *, unnest(range(1, least(1001, length(h) // 2 - 48))) AS i FROM part)),
first AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
starts AS (SELECT win.doc_id, i FROM win JOIN first ON first.k = win.k AND m < win.doc_id),
runs AS (SELECT doc_id, min(i) AS a, max(i) + 49 AS b FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM starts)) GROUP BY doc_id, run),
gaps AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM runs),
left_ AS (SELECT gaps.doc_id, count(*) AS spans, sum(b - a + 1) AS gone, max(b) AS last, string_agg(substring(h, 2 * before + 1, 2 * (a - 1 - before)), '' ORDER BY a) AS kept FROM gaps JOIN h ON h.doc_id = gaps.doc_id GROUP BY 1)
SELECT h.doc_id, n AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(CASE WHEN last IS NULL THEN h ELSE concat(kept, substring(h, 2 * last + 1)) END)) AS kept_sha256 FROM h LEFT JOIN left_ ON left_.doc_id = h.doc_id""",
    "op12_turn_repair": f"""
WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC32.format("concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS h FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE WHEN h = 1 THEN '' WHEN h = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS again FROM c WHERE h <> 0),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, again) AS k, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, again) > 1 AS seen, right(rtrim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), 1) AS last FROM d),
f AS (SELECT *, last = '' OR seen AS gone, CASE WHEN last IN ('.', '!', '?') THEN 0 ELSE 3 END AS more, role[1] AS keeps, concat(role, ':', text, chr(10)) AS body, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY k) || role[1] AS pair FROM r),
s AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (last = '') AS blank, count(*) FILTER (last <> '' AND seen) AS duplicate, count(*) FILTER (NOT gone AND more > 0) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(k) AS k FROM f GROUP BY 1),
b AS (SELECT conv_id, k, struct_pack(c := 0, e := '', t := '') AS b0, struct_pack(c := 6, e := 'II', t := concat('user:', chr(10), 'assistant:', chr(10))) AS b1, struct_pack(c := 3, e := 'I', t := concat('assistant:', chr(10))) AS b2, struct_pack(c := 0, e := '', t := '') AS b3 FROM s UNION ALL {_turn_steps()})
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(b0.c, 0) AS BIGINT) AS cost, coalesce(b0.e, '') AS audit, sha256(coalesce(left(b0.t, length(b0.t) - 1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN s ON s.conv_id = o.conv_id LEFT JOIN b ON b.conv_id = o.conv_id AND b.k = 0""",
    "op13_periodic_runs": f"""
WITH d AS (SELECT doc_id, ws, len(ws) AS n, {_CRC32.format("CAST(doc_id AS VARCHAR)")} AS h FROM (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents)),
a AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n ELSE n END AS a, CASE WHEN h % 10 = 0 AND n > 0 THEN 1 + (n - (h // 10) % n) // (3 + (h // 10) % 8) ELSE 1 END AS q FROM d),
w AS (SELECT doc_id, i, ws[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % q END] AS w FROM (SELECT *, unnest(range(n)) AS i FROM a)),
same AS (SELECT x.doc_id, x.i, y.i - x.i AS p FROM w x JOIN w y ON y.doc_id = x.doc_id AND y.w = x.w AND y.i > x.i),
runs AS (SELECT doc_id, s, n, min(p) AS p FROM (SELECT doc_id, min(i) AS s, count(*) + p AS n, p FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS g FROM same) GROUP BY doc_id, p, g HAVING count(*) >= p AND count(*) + p >= 12) GROUP BY doc_id, s, n),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, s, p) = 1),
listed AS (SELECT doc_id, count(*) AS k, string_agg(concat(s, ',', n, ',', p, chr(10)), '' ORDER BY s, p) AS t FROM runs GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + p, s + n)) AS i FROM runs),
kept AS (SELECT w.doc_id, string_agg(w.w, ' ' ORDER BY w.i) AS t FROM w ANTI JOIN gone ON gone.doc_id = w.doc_id AND gone.i = w.i GROUP BY 1)
SELECT d.doc_id, coalesce(k, 0) AS n_runs, s AS start, best.n AS length, p AS period, 1000 * best.n // p AS exponent_milli, sha256(coalesce(listed.t, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256
FROM d LEFT JOIN best ON best.doc_id = d.doc_id LEFT JOIN listed ON listed.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id""",
}
