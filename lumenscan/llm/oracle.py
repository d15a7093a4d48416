"""DuckDB SQL for the queries of this subpackage that SQL can express; over whole texts it is too slow for op8, whose tests use brute force."""

from __future__ import annotations

_ESCAPED = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '[', '&#91;')"
_WORDS = r"list_filter(string_split_regex(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{}'), lambda w: w <> '')"


def _op2() -> str:
    return f"""WITH t AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')) v(conv_id, turn, role, text)),
      c AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role NULLS FIRST, text NULLS FIRST) AS n, coalesce(role, '') AS role, coalesce(text, '') AS text FROM t)
      SELECT conv_id, count(*) AS n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY n)) AS turns_sha256, coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
        sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY n), '')) AS loss_sha256, sum(17 + length(replace({_ESCAPED.format('role')}, chr(10), '&#10;')) + length({_ESCAPED.format('text')}))::BIGINT AS formatted_chars
      FROM c GROUP BY conv_id"""


def _op3() -> str:
    words = _WORDS.format("coalesce(text, '')", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    return f"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, {words} AS w FROM documents), b AS (SELECT item_id, {words} AS w FROM benchmark),
      item_windows AS (SELECT item_id, array_to_string(w[i + 1 : i + 13], ' ') AS window, least(len(w), 13) AS size FROM b, unnest(range(0, greatest(1, len(w) - 12))) u(i) WHERE len(w) > 0),
      sizes AS (SELECT DISTINCT size FROM item_windows),
      doc_windows AS (SELECT row, i, size, array_to_string(w[i + 1 : i + size], ' ') AS window FROM d, sizes, unnest(range(0, greatest(0, len(w) - size + 1))) u(i)),
      met AS (SELECT DISTINCT row, i, x.size, item_id FROM doc_windows x JOIN item_windows y ON x.size = y.size AND x.window = y.window),
      hits AS (SELECT row, count(DISTINCT i + j) AS n_hit FROM met, unnest(range(0, size)) u(j) GROUP BY row),
      items AS (SELECT row, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT row, CAST(item_id AS VARCHAR) AS id FROM met) GROUP BY row)
      SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
      FROM d LEFT JOIN hits USING (row) LEFT JOIN items USING (row)"""


def _op5() -> str:
    # five hexadecimal digits are four base-32 digits
    digit = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[(v // {} % 32)::INTEGER + 1]"
    quad = " || ".join(digit.format(32**k) for k in (3, 2, 1, 0))
    value = " + ".join(f"(strpos('0123456789abcdef', h[{i}:{i}]) - 1) * {16 ** (5 - i)}" for i in range(1, 6))
    return f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), s AS (SELECT *, sha1(html) AS digest, min(page_id) OVER (PARTITION BY html) AS first_id FROM p),
      parts AS (SELECT digest, k, {value} AS v FROM (SELECT digest, k, digest[5 * k + 1 : 5 * k + 5] AS h FROM (SELECT DISTINCT digest FROM s), unnest(range(0, 8)) u(k))),
      base AS (SELECT digest, string_agg({quad}, '' ORDER BY k) AS payload_digest FROM parts GROUP BY digest)
      SELECT page_id, strlen(html)::BIGINT AS payload_bytes, payload_digest, CASE WHEN first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first_id <> page_id THEN first_id END AS refers_to, TRUE AS block_ok, TRUE AS payload_ok
      FROM s JOIN base USING (digest)"""


def _op10() -> str:
    words = _WORDS.format("coalesce(text, '')", r"[\x20\x09-\x0D]+")
    return f"""WITH RECURSIVE d AS (SELECT doc_id, {words} AS w FROM documents),
      s AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + 4], ' ') AS shingle FROM d, unnest(range(0, greatest(1, len(w) - 3))) u(i) WHERE len(w) > 0),
      n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
      pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
      links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
      reach AS (SELECT a, a AS b FROM (SELECT DISTINCT a FROM links) UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
      least AS (SELECT a AS doc_id, min(b) AS c FROM reach GROUP BY a)
      SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c, d.doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least USING (doc_id)"""


def _op13() -> str:
    # floors of quotients by a remainder that is never negative, since // cuts towards zero
    rounds, before = [], "c0"
    for k in range(1, 5):
        rounds.append(f"""d{k} AS (SELECT v.row, c.k, sum((v.x - c.x) * (v.x - c.x)) AS d FROM v JOIN {before} c USING (i) GROUP BY v.row, c.k),
      a{k} AS (SELECT row, k, d FROM d{k} QUALIFY row_number() OVER (PARTITION BY row ORDER BY d, k) = 1)""")
        if k < 4:
            rounds.append(f"""m{k} AS (SELECT k, i, sum(x) AS s, count(*) AS n FROM v JOIN a{k} USING (row) GROUP BY k, i),
      c{k} AS (SELECT k, i, CASE WHEN n IS NULL THEN x ELSE (s - ((s % n) + n) % n) // n END AS x FROM {before} LEFT JOIN m{k} USING (k, i))""")
            before = f"c{k}"
    steps = ",\n      ".join(rounds)
    return f"""WITH kept AS (SELECT row_number() OVER () AS row, vec_id, embedding FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
      v AS (SELECT row, i, CAST(floor(64 * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS x FROM kept, unnest(range(1, 65)) u(i)),
      first AS (SELECT row, row_number() OVER (ORDER BY sha256(concat('1:', vec_id))) - 1 AS k FROM kept QUALIFY k < 16),
      c0 AS (SELECT k, i, x FROM v JOIN first USING (row)),
      {steps},
      digest AS (SELECT k, sha256(string_agg(CAST(x AS BIGINT), ',' ORDER BY i)) AS centroid_sha256 FROM {before} GROUP BY k)
      SELECT vec_id, k::INTEGER AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256 FROM a4 JOIN kept USING (row) JOIN digest USING (k)"""


def oracle_sql() -> dict[str, str]:
    return {"op2_chat": _op2(), "op3_decontamination": _op3(), "op5_warc": _op5(), "op10_jaccard_join": _op10(), "op13_clustering": _op13()}
