"""DuckDB SQL for the text queries whose whole result SQL can state."""

from __future__ import annotations

from assetlens.llm.repetition import Rules

BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def _words(text: str) -> str:
    """Defines p(doc_id, i, w): every word of every document with its place."""
    return f"w AS (SELECT doc_id, regexp_extract_all({text}, '{WORD}') AS ws FROM documents), p AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM w)"


def _gram(n: int) -> str:
    return f"CASE WHEN count(*) OVER g{n} = {n} THEN string_agg(w, ' ') OVER g{n} END AS s{n}"


def quality_rules(rules: Rules = Rules()) -> str:
    lengths = sorted({3, *(n for n, _ in rules.coverage)})
    frames = ", ".join(f"g{n} AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING)" for n in lengths)
    again = ", ".join(f"s{n} IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, s{n}) > 1 AS d{n}" for n in lengths)
    back = ", ".join(f"bool_or(d{n}) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS c{n}" for n in lengths)
    sums = ", ".join(f"coalesce(sum(length(w)) FILTER (c{n}), 0) AS k{n}" for n in lengths)
    coverage = ", ".join(f"coalesce(k{n}, 0) / greatest(word_chars, 1) AS coverage_{n}" for n, _ in rules.coverage)
    over = " OR ".join(f"coverage_{n} > {most}" for n, most in rules.coverage)
    return f"""WITH {_words("coalesce(text, '')")}, g AS (SELECT doc_id, i, w, {', '.join(map(_gram, lengths))} FROM p WINDOW {frames}),
 d AS (SELECT doc_id, i, w, {again} FROM g), c AS (SELECT doc_id, w, {back} FROM d),
 a AS (SELECT doc_id, count(*) AS n, sum(length(w)) AS chars, count(*) FILTER (c3) AS repeats, {sums} FROM c GROUP BY 1),
 l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
 m AS (SELECT doc_id, line, count(*) AS times, length(regexp_replace(line, '{BLANK}', '', 'g')) AS chars FROM l WHERE regexp_matches(line, '{WORD}') GROUP BY 1, 2),
 b AS (SELECT doc_id, sum(times - 1) AS dup_lines, sum(times * chars) FILTER (times > 1) AS line_chars FROM m GROUP BY 1),
 r AS (SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(chars, 0)::BIGINT AS word_chars, (length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  coalesce(dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(repeats, 0)::BIGINT AS n_repeat_words, coalesce(line_chars, 0) AS line_chars, {', '.join(f'k{n}' for n in lengths)} FROM documents d LEFT JOIN a ON a.doc_id = d.doc_id LEFT JOIN b ON b.doc_id = d.doc_id),
 v AS (SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words AS base_failed, line_chars / greatest(word_chars, 1) AS line_coverage, {coverage} FROM r)
 SELECT *, NOT (base_failed OR line_coverage > {rules.max_line_coverage} OR n_symbols > {rules.max_symbols_per_word} * n_words OR {over}) AS kept FROM v"""


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def near_duplicates(words: int = 5, percent: int = 75) -> str:
    lower = f"translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}')"
    return f"""WITH RECURSIVE {_words(lower)},
 f AS (SELECT doc_id, string_agg(w, ' ') OVER g AS s, count(*) OVER g AS k, i FROM p WINDOW g AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {words - 1} FOLLOWING)),
 s AS (SELECT DISTINCT doc_id, s FROM f WHERE k = {words} OR i = 0), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
 q AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
 e AS (SELECT a, b FROM q JOIN n u ON u.doc_id = a JOIN n v ON v.doc_id = b WHERE 100 * c >= {percent} * (u.n + v.n - c)),
 t AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(node, reach) AS (SELECT a, a FROM t UNION SELECT r.node, t.b FROM r JOIN t ON r.reach = t.a),
 k AS (SELECT node, min(reach) AS low FROM r GROUP BY 1)
 SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(low, d.doc_id) AS component_id, coalesce(low, d.doc_id) = d.doc_id AS kept FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN k ON k.node = d.doc_id"""


def member_lloyd(parts: int = 8, entries: int = 16, rounds: int = 6, width: int = 8, scale: int = 4096) -> str:
    """Every round written out; ``width`` is the length of a part of the given vectors."""
    nearest = f"arg_min(e, (d, e)) AS e, min(d) AS d FROM (SELECT r, v.p, v.x AS x, e, list_sum([{', '.join(f'(v.x[{i}] - b.x[{i}]) * (v.x[{i}] - b.x[{i}])' for i in range(1, width + 1))}]) AS d"
    mean = ", ".join(f"floor(sum(x[{i}])::DOUBLE / count(*))::BIGINT" for i in range(1, width + 1))
    steps = "".join(
        f""",
 a{k} AS MATERIALIZED (SELECT r, p, any_value(x) AS x, {nearest} FROM v JOIN b{k} b ON b.p = v.p) GROUP BY r, p),
 b{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM b{k} b LEFT JOIN (SELECT p, e, [{mean}] AS x FROM a{k} GROUP BY 1, 2) m ON m.p = b.p AND m.e = b.e)"""
        for k in range(rounds)
    )
    return f"""WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, embedding FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 v AS MATERIALIZED (SELECT r, p, list_transform(embedding[p * {width} + 1 : (p + 1) * {width}], lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS x FROM k, range({parts}) t(p)),
 b0 AS (SELECT p, r - 1 AS e, x FROM v WHERE r <= {entries}){steps},
 f AS (SELECT r, p, {nearest} FROM v JOIN b{rounds} b ON b.p = v.p) GROUP BY r, p),
 c AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM f GROUP BY 1),
 s AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds})
 SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM k JOIN c ON c.r = k.r, s"""


def ranked_search(best: int = 20) -> str:
    term = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

    def terms(table: str, key: str) -> str:
        return f"SELECT {key}, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '{term}')) AS t FROM {table}"

    return f"""WITH c AS MATERIALIZED (SELECT doc_id, t, count(*) AS tf FROM ({terms('documents', 'doc_id')}) GROUP BY 1, 2), n AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM c GROUP BY 1),
 s AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM n), q AS (SELECT item_id, t, count(*) AS times FROM ({terms('benchmark', 'item_id')}) GROUP BY 1, 2),
 w AS (SELECT t, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM c, s GROUP BY 1),
 x AS (SELECT item_id, c.doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // total))))::BIGINT AS score FROM q JOIN w ON w.t = q.t JOIN c ON c.t = q.t JOIN n ON n.doc_id = c.doc_id, s GROUP BY 1, 2),
 r AS (SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score FROM x WHERE score > 0)
 SELECT * FROM r WHERE rank <= {best}"""


def chat_digests() -> str:
    def escape(text: str) -> str:
        return rf"regexp_replace(regexp_replace({text}, '(\[)(\\|/?(INST|TURN)\])', '\1\\\2', 'g'), '(<)(\\|/?s>|</?SYS>>)', '\1\\\2', 'g')"

    marks = "CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 9 WHEN 'system' THEN 17 ELSE 17 + length(name) + length(length(name)::VARCHAR) END"
    return f"""WITH c AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -1, turn, CASE turn WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) t(turn)),
 t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM c), e AS (SELECT *, {escape('text')} AS body, {escape('role')} AS name FROM t),
 g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, body) AS said, coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, body) FILTER (role = 'assistant'), '') AS loss,
  sum({marks} + length(body))::BIGINT AS formatted_chars, sum((body <> text)::INTEGER)::BIGINT AS escaped_turns FROM e GROUP BY 1)
 SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars, escaped_turns FROM g"""
