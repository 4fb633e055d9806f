"""DuckDB SQL that gives the rows of queries by a plainer path."""

_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: The entries of the CRC-32 table, by rule; with ``crc`` at hand, ``_CRC`` is the CRC of a text's bytes.
_CRC_TABLE = "crc AS (SELECT list(c ORDER BY k) AS t FROM (SELECT k, list_reduce(range(8), lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, k) AS c FROM (SELECT unnest(range(256)) AS k)))"
_CRC = "xor(list_reduce([('0x' || h)::BIGINT FOR h IN regexp_extract_all(hex({}), '..')], lambda a, b: xor(a >> 8, crc.t[(xor(a, b) & 255) + 1]), 4294967295), 4294967295)"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen(({c})::VARCHAR) || ':' || ({c})::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _climb(name: str, start: str, levels: int) -> list[str]:
    """``name``0 (grp, i, d, n) and the levels above it; ``name``r0, ... are the runs of each level."""
    out = [f"{name}0 AS ({start})"]
    for k in range(levels):
        out.append(f"{name}r{k} AS (SELECT grp, i // 16 AS r, list(d ORDER BY i) AS ds, max(n) AS n FROM {name}{k} GROUP BY ALL)")
        out.append(f"{name}{k + 1} AS (SELECT grp, r AS i, CASE WHEN n = 1 THEN ds[1] ELSE sha256(array_to_string(ds, '')) END AS d, count(*) OVER (PARTITION BY grp) AS n FROM {name}r{k})")
    return out


def _fold(to: str, name: str, start: str, levels: int) -> list[str]:
    """``to``0 (rn, grp, j, cur, proof) and what it folds to, level by level."""
    out = [f"{to}0 AS ({start})"]
    for k in range(levels):
        rest = "ds[1:j % 16] || {} ds[j % 16 + 2:]"
        out.append(
            f"{to}{k + 1} AS (SELECT rn, f.grp, j // 16 AS j, CASE WHEN n = 1 THEN cur ELSE sha256(array_to_string({rest.format('[cur] ||')}, '')) END AS cur, "
            f"proof || CASE WHEN n = 1 THEN '' ELSE array_to_string({rest.format('')}, '') END AS proof FROM {to}{k} f JOIN {name}r{k} x ON x.grp = f.grp AND x.r = j // 16)"
        )
    return out


def _merkle(levels: int = 8) -> str:
    """Trees of up to 16^levels nodes a group, as many groups."""
    tampered = f"CASE WHEN {_CRC.format('doc_id::VARCHAR')} % 5 = 0 THEN {_leaf(_LOW.format('text'))} ELSE {_leaf('text')} END"
    ctes = [
        _CRC_TABLE,
        f"leaves AS (SELECT row_number() OVER () AS rn, doc_id, coalesce('=' || source, '') AS grp, {_leaf('text')} AS leaf, {tampered} AS tampered FROM documents, crc)",
        "placed AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf, rn) - 1 AS i FROM leaves)",
        *_climb("s", "SELECT grp, i, leaf AS d, count(*) OVER (PARTITION BY grp) AS n FROM placed", levels),
        *_climb("t", f"SELECT 0 AS grp, row_number() OVER (ORDER BY grp) - 1 AS i, d, count(*) OVER () AS n FROM s{levels}", levels),
        *_fold("a", "s", "SELECT rn, grp, i AS j, tampered AS cur, '' AS proof FROM placed", levels),
        f"groups AS (SELECT grp, d, row_number() OVER (ORDER BY grp) - 1 AS i FROM s{levels})",
        *_fold("b", "t", f"SELECT rn, 0 AS grp, i AS j, cur, proof FROM a{levels} JOIN groups USING (grp)", levels),
    ]
    return f"WITH {', '.join(ctes)} SELECT doc_id, leaf, g.d AS subroot, t.d AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = t.d AS verified FROM b{levels} JOIN leaves l USING (rn) JOIN groups g ON g.grp = l.grp, t{levels} t"


_WORDS = f"regexp_extract_all({_LOW.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLE_SQL = {
    "op11_merkle_manifest": _merkle(),
    "op12_line_dedup": rf"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT rn, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d),
k AS (SELECT *, {_LOW.format(r"regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')")} AS key FROM l),
c AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT rn) >= 10)
SELECT doc_id, count(*) AS n_lines, count(c.key) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN c USING (key) GROUP BY rn, doc_id
""",
    "op13_target_resampling": f"""
WITH {_CRC_TABLE},
d AS (SELECT 0 AS side, row_number() OVER () AS rn, doc_id, {_WORDS} AS w FROM documents UNION ALL SELECT 1, row_number() OVER (), NULL, {_WORDS} FROM benchmark),
f AS (SELECT side, rn, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT *, unnest(generate_series(1, len(w) - k + 1)) AS i FROM d, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k)),
b AS (SELECT g, {_CRC.format('g')} % 10000 AS bucket FROM (SELECT DISTINCT g FROM f), crc),
n AS (SELECT bucket, count(*) FILTER (WHERE side = 0) AS s, count(*) FILTER (WHERE side = 1) AS t FROM f JOIN b USING (g) GROUP BY bucket),
gain AS (SELECT bucket, floor(1000 * ln((t::DOUBLE + 1) * (sum(s) OVER () + 10000)::DOUBLE / ((s::DOUBLE + 1) * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain FROM n),
v AS (SELECT rn, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM f JOIN b USING (g) JOIN gain USING (bucket) WHERE side = 0 GROUP BY rn),
h AS (SELECT rn, doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, ('0x' || sha256('42:' || coalesce(doc_id::VARCHAR, ''))[:8])::BIGINT AS h FROM d LEFT JOIN v USING (rn) WHERE side = 0),
s AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM h),
r AS (SELECT rn, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, rn) AS rank FROM s WHERE n_words >= 20)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN rank <= 5 * (SELECT count(*) FROM r) // 100 THEN rank END AS rank FROM s LEFT JOIN r USING (rn)
""",
    "op8_url_filters": r"""
WITH rules(verdict, host, path) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
p AS (
  SELECT page_id, row_number() OVER () AS rn,
    translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
m AS (
  SELECT p.page_id, p.rn, p.host, p.path, r.host || r.path AS rule, r.verdict,
    row_number() OVER (PARTITION BY p.rn ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) AS k
  FROM p LEFT JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
""",
    "op5_decontaminate": r"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT rn, i, m, array_to_string(w[i:i + m - 1], ' ') AS g
  FROM (SELECT rn, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM d, (SELECT DISTINCT m FROM iw) WHERE len(w) >= m)),
h AS (SELECT dw.rn, dw.i, dw.m, iw.item_id FROM dw JOIN iw USING (m, g)),
n AS (SELECT rn, count(DISTINCT p) AS n_hit FROM (SELECT rn, unnest(generate_series(i, i + m - 1)) AS p FROM h) GROUP BY rn),
t AS (SELECT rn, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM h GROUP BY rn)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (rn) LEFT JOIN t USING (rn)
""",
}
