"""DuckDB SQL for the operators that SQL can express: plain definitions, not the operators' methods."""

from __future__ import annotations

_SPLIT = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def _shingled(table: str, key: str, name: str) -> str:
    return rf"""{name}_w AS (SELECT {key}, string_split(t, ' ') AS w FROM (SELECT {key}, trim(regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS t FROM {table}) WHERE t <> ''),
{name} AS (SELECT DISTINCT {key}, unnest(CASE WHEN len(w) >= 5 THEN [array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)] ELSE [array_to_string(w, ' ')] END) AS s FROM {name}_w)"""


DECONTAMINATION = f"""WITH {_shingled("documents", "doc_id", "l")}, {_shingled("benchmark", "item_id", "b")},
k AS (SELECT DISTINCT len(w) AS k FROM b_w WHERE len(w) < 5),
d AS (SELECT doc_id, s FROM l JOIN l_w USING (doc_id) WHERE len(w) >= 5 UNION SELECT doc_id, unnest([array_to_string(w[i:i + k - 1], ' ') for i in range(1, len(w) - k + 2)]) FROM l_w JOIN k ON len(w) >= k),
n AS (SELECT item_id, count(*) AS n_shingles FROM b GROUP BY item_id)
SELECT doc_id, item_id, any_value(n_shingles) AS n_shingles, count(*) AS n_found, round(count(*) / any_value(n_shingles)::DOUBLE, 6) AS containment
FROM d JOIN b USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id HAVING count(*) >= ceil(any_value(n_shingles) * 0.8::DOUBLE - 1e-9)"""

SUBSTRING = f"""WITH d AS (SELECT doc_id, {_SPLIT} AS w FROM documents),
p AS (SELECT doc_id, generate_subscripts(w, 1) AS i, unnest(w) AS word, unnest([CASE WHEN i <= len(w) - 34 THEN md5(array_to_string(w[i:i + 34], ' ')) END for i in range(1, len(w) + 1)]) AS h FROM d),
c AS (SELECT *, h IS NOT NULL AND count(*) OVER (PARTITION BY h) > 1 AS again FROM p),
m AS (SELECT doc_id, i, word, max(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM c),
k AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM m GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON k.doc_id = d.doc_id"""

LINES = r"""WITH l AS (SELECT doc_id, generate_subscripts(a, 1) AS pos, unnest(a) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)),
n AS (SELECT *, trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm FROM l),
u AS (SELECT norm, min((doc_id, pos)) AS first, length(norm) AS n, string_split(norm, '') AS c FROM n WHERE norm <> '' GROUP BY norm),
h AS (SELECT *, substr(norm, 1, n // 2) AS a0, substr(norm, n // 2 + 1) AS a1, substr(norm, 1, (n - 1) // 2) AS b0, substr(norm, (n - 1) // 2 + 1 + 1) AS b2 FROM u),
q AS (SELECT x.norm AS x, y.norm AS y, x.first AS fx, y.first AS fy, x.c AS cx, y.c AS cy FROM h x JOIN h y ON x.n = y.n AND x.a0 = y.a0 AND x.norm < y.norm
UNION SELECT x.norm, y.norm, x.first, y.first, x.c, y.c FROM h x JOIN h y ON x.n = y.n AND x.a1 = y.a1 AND x.norm < y.norm
UNION SELECT x.norm, y.norm, x.first, y.first, x.c, y.c FROM h x JOIN h y ON x.n = y.n - 1 AND x.a0 = y.b0
UNION SELECT x.norm, y.norm, x.first, y.first, x.c, y.c FROM h x JOIN h y ON x.n = y.n - 1 AND x.a1 = y.b2),
f AS (SELECT *, coalesce([i for i in range(1, len(cx) + 1) if cx[i] <> cy[i]][1], len(cx) + 1) AS p FROM q),
near AS (SELECT DISTINCT CASE WHEN fx < fy THEN y ELSE x END AS norm FROM f WHERE CASE WHEN length(x) = length(y) THEN substr(x, p + 1) = substr(y, p + 1) ELSE substr(x, p) = substr(y, p + 1) END),
k AS (SELECT n.doc_id, n.pos, n.line, n.norm <> '' AS filled, n.norm <> '' AND u.first = (n.doc_id, n.pos) AND near.norm IS NOT NULL AS is_near, n.norm = '' OR (u.first = (n.doc_id, n.pos) AND near.norm IS NULL) AS stays
FROM n LEFT JOIN u ON u.norm = n.norm LEFT JOIN near ON near.norm = n.norm)
SELECT doc_id, count(*) FILTER (filled) AS n_lines, count(*) FILTER (NOT stays) AS n_removed, count(*) FILTER (is_near) AS n_near, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (stays), '')) AS kept_sha256 FROM k GROUP BY doc_id"""

MIXING = f"""WITH RECURSIVE s AS MATERIALIZED (SELECT doc_id, source, len({_SPLIT}) AS size, md5(concat_ws('|', '20260101', coalesce(CAST(doc_id AS VARCHAR), 'null'), coalesce(source, 'null'), md5(coalesce(text, '')))) AS key FROM documents),
z AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source),
r AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w, 2.0::DOUBLE * source_size AS cap FROM z),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
t AS (SELECT *, least(cap, (SELECT arg_min(level, cap / w) FROM l WHERE cap / w >= level) * w) AS target FROM l),
g AS (SELECT source, length(bin(size)) AS digits, sum(size)::DOUBLE AS words FROM s WHERE size > 0 GROUP BY ALL),
i AS (SELECT g.*, t.target, (t.target - coalesce(sum(2.0::DOUBLE * words) OVER (PARTITION BY g.source ORDER BY digits DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(digits * words) OVER (PARTITION BY g.source ORDER BY digits DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM g JOIN t ON g.source IS NOT DISTINCT FROM t.source),
j AS (SELECT *, least(2.0::DOUBLE, (arg_max(level, digits) FILTER (WHERE 2.0::DOUBLE * words / (digits * words) >= level) OVER (PARTITION BY source)) * digits) AS e FROM i),
b AS (SELECT *, floor(e + 1e-9::DOUBLE) AS base, CASE WHEN e - floor(e + 1e-9::DOUBLE) > 1e-9::DOUBLE THEN e - floor(e + 1e-9::DOUBLE) END AS p FROM j),
y AS (SELECT *, target - sum(base * words) OVER (PARTITION BY source) AS open_, sum(CASE WHEN p IS NOT NULL THEN words END) OVER (PARTITION BY source) AS drawn FROM b),
u AS (SELECT s.*, source_size, t.target, base, p, open_, (CAST('0x' || substr(key, 1, 13) AS BIGINT) + 0.5::DOUBLE) / (1::BIGINT << 52)::DOUBLE AS u,
 greatest(open_ / greatest(drawn - open_, 1.0::DOUBLE), 1e-9::DOUBLE) AS even FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source LEFT JOIN y ON s.source IS NOT DISTINCT FROM y.source AND length(bin(s.size)) = y.digits AND s.size > 0),
x AS (SELECT *, u / (1 - u) / (p / (1 - p)) * even AS q FROM u),
v AS MATERIALIZED (SELECT *, q / (1 + q) AS v FROM x),
c AS MATERIALIZED (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY v, key) <= open_ AS fits FROM v WHERE v IS NOT NULL),
a AS (SELECT source, max(open_) - coalesce(sum(size) FILTER (fits), 0) AS gap FROM c GROUP BY source),
n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size DESC) AS k FROM (SELECT c.source, size, count(*) AS n FROM c JOIN a ON c.source IS NOT DISTINCT FROM a.source WHERE NOT fits AND size < 2 * gap GROUP BY ALL)),
f AS (SELECT source, 0::BIGINT AS k, gap::DOUBLE AS gap, 0::BIGINT AS size, 0::BIGINT AS t, NULL::BIGINT AS next FROM a
 UNION ALL SELECT f.source, n.k, f.gap - least(n.n, floor(f.gap / n.size)) * n.size, n.size, least(n.n, floor(f.gap / n.size))::BIGINT, CASE WHEN floor(f.gap / n.size) < n.n THEN n.size ELSE f.next END FROM f JOIN n ON f.source IS NOT DISTINCT FROM n.source AND n.k = f.k + 1),
m AS (SELECT source, arg_max(gap, k) AS gap, arg_max(coalesce(next, 0), k) AS next FROM f GROUP BY source),
o AS (SELECT source, size, sum(t) * size AS most FROM (SELECT source, size, t FROM f WHERE t > 0 UNION ALL SELECT source, next, 1 FROM m WHERE next > 0 AND next - gap < gap) GROUP BY source, size),
d AS (SELECT DISTINCT source, key FROM (SELECT c.source, key, sum(c.size) OVER (PARTITION BY c.source, c.size ORDER BY v, key) <= most AS fits FROM c JOIN o ON c.source IS NOT DISTINCT FROM o.source AND c.size = o.size WHERE NOT c.fits) WHERE fits
 UNION SELECT source, key FROM c WHERE fits),
e AS (SELECT v.*, CASE WHEN v.size > 0 THEN (base + (d.key IS NOT NULL)::INT)::BIGINT ELSE 0 END AS copies FROM v LEFT JOIN d ON v.source IS NOT DISTINCT FROM d.source AND v.key = d.key)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM e"""


def _crc_of_nibbles() -> list[int]:
    """What each four bits add to a CRC-32."""
    out = []
    for n in range(16):
        for _ in range(4):
            n = n >> 1 ^ 0xEDB88320 * (n & 1)
        out.append(n)
    return out


def _packed(steps: int, capacity: str, source: str) -> str:
    """a1 to aN: where a greedy packing of the ordered groups, whose running sums are the list c, ends each shard."""
    for i in range(1, steps + 1):
        last = f"a{i - 1}" if i > 1 else "0"
        source = f"(SELECT *, coalesce(list_max(list_filter(c, lambda x: x <= {last} + {capacity})), {last})::BIGINT AS a{i} FROM {source})"
    return source


_NIBBLES = "flatten(list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda p: [instr('0123456789ABCDEF', p[2]) - 1, instr('0123456789ABCDEF', p[1]) - 1]))"

SHARDING = f"""WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS t, strlen(coalesce(text, '')) + 1 AS size, CAST('0x' || substr(md5(coalesce(text, '')), 1, 16) AS UBIGINT)::HUGEINT AS whole FROM documents),
e AS MATERIALIZED (SELECT *, (CASE WHEN whole >= 9223372036854775808::HUGEINT THEN whole - 18446744073709551616::HUGEINT ELSE whole END)::BIGINT AS h,
 xor(list_reduce(list_prepend(4294967295::BIGINT, {_NIBBLES}::BIGINT[]), lambda x, y: xor(x >> 4, ({_crc_of_nibbles()}::BIGINT[])[(xor(x, y) & 15) + 1])), 4294967295::BIGINT) AS text_crc32 FROM d),
g AS MATERIALIZED (SELECT h, sum(sum(size)) OVER (ORDER BY h)::BIGINT AS upto FROM e GROUP BY h),
l AS MATERIALIZED (SELECT list(upto ORDER BY upto) AS c, max(upto) AS total FROM g),
b AS (SELECT (total + 7) // 8 AS low, total AS high FROM l
 UNION ALL SELECT CASE WHEN a8 = total THEN low ELSE (low + high) // 2 + 1 END, CASE WHEN a8 = total THEN (low + high) // 2 ELSE high END FROM {_packed(8, "(low + high) // 2", "(SELECT low, high, c, total FROM b, l WHERE low < high)")}),
p AS MATERIALIZED (SELECT * FROM {_packed(7, "capacity", "(SELECT min(high) AS capacity, any_value(c) AS c FROM b, l)")}),
s AS (SELECT e.*, {" + ".join(f"(upto > a{i})::INT" for i in range(1, 8))} AS shard, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || CAST(h AS VARCHAR)), 1, 4) AS BIGINT) % 2048 AS cell FROM e JOIN g USING (h), p)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY cell, doc_id NULLS FIRST, h) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s"""

MINHASH = rf"""WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN [array_to_string(w[i:i + 3], ' ') for i in range(1, len(w) - 2)] WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
n AS MATERIALIZED (SELECT w.doc_id, count(s.s) AS n FROM w LEFT JOIN s ON s.doc_id = w.doc_id GROUP BY w.doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n u ON u.doc_id = a JOIN n v ON v.doc_id = b WHERE 100 * common >= 80 * (u.n + v.n - common)),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT l.a, r.b FROM r JOIN l ON l.b = r.a)
SELECT n.doc_id, n.n AS n_shingles, min(r.b) AS component_id, n.doc_id = min(r.b) AS kept FROM n JOIN r ON r.a = n.doc_id GROUP BY n.doc_id, n.n"""

PREFIX_TRIE = f"""WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS j FROM conversations WHERE conv_id IS NOT NULL),
o AS MATERIALIZED (SELECT c, CAST(c AS VARCHAR) AS t, list({{'r': r, 'x': x}} ORDER BY j) AS ts FROM t GROUP BY c),
h AS MATERIALIZED (SELECT c, ts, xor(list_reduce(list_prepend(4294967295::BIGINT, {_NIBBLES}::BIGINT[]), lambda x, y: xor(x >> 4, ({_crc_of_nibbles()}::BIGINT[])[(xor(x, y) & 15) + 1])), 4294967295::BIGINT) % 9 AS h FROM o),
b AS MATERIALIZED (SELECT h.c, list_concat(coalesce(p.ts[1:h.h], []), h.ts[h.h + 1:]) AS ts FROM h LEFT JOIN o p ON p.c = h.c - h.c % 5),
n AS MATERIALIZED (SELECT c, d, md5(CAST(to_json(ts[1:d]) AS VARCHAR)) AS k, CASE WHEN d > 0 THEN md5(CAST(to_json(ts[1:d - 1]) AS VARCHAR)) END AS up, CASE WHEN d > 0 THEN strlen(ts[d].x) ELSE 0 END AS bytes, d = len(ts) AS e FROM (SELECT c, ts, unnest(range(len(ts) + 1)) AS d FROM b)),
g AS MATERIALIZED (SELECT d, k, any_value(up) AS up, min(c) AS c, count(*) AS n, (count(*) - 1) * any_value(bytes) AS own, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (e), '')) AS ends_sha256 FROM n GROUP BY d, k),
f AS MATERIALIZED (SELECT g.*, (SELECT count(*) FROM g x WHERE x.d = g.d + 1 AND x.up = g.k) AS n_children FROM g),
s AS (SELECT n.d, n.k, count(*) FILTER (f.n_children = 0) AS n_leaves, sum(f.own)::BIGINT AS saved_tokens FROM f JOIN n ON n.c = f.c AND n.d <= f.d GROUP BY n.d, n.k)
SELECT f.c AS conv_id, f.d AS depth, u.c AS parent_conv_id, f.n AS n_convs, f.n_children, s.n_leaves, s.saved_tokens, f.ends_sha256 FROM f JOIN s ON s.d = f.d AND s.k = f.k LEFT JOIN f u ON u.d = f.d - 1 AND u.k = f.up"""
