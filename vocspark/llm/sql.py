"""DuckDB twins of the queries that SQL can express."""

from __future__ import annotations

from . import kmeans, mixing, periodic, sharding

_WORDS = "len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))"


def _unit(text: str) -> str:
    """A draw in (0, 1) from the first 52 bits of the md5 of an SQL text."""
    return f"((('0x' || substr(md5({text}), 1, 13))::BIGINT)::DOUBLE + 0.5) / 4503599627370496.0"


def _descent(name: str, n_shards: int) -> str:
    """CTEs that descend the tree: `name` has doc_id (as text k) and its shard."""
    nodes = sharding.topology(n_shards)
    ctes, source, at = [], "keys", "0"
    for level, label in enumerate(sharding.LEVELS):
        values = ", ".join(f"({n.parent}, {n.id}, {n.weight!r}::DOUBLE)" for n in nodes if n.level == level)
        draw = f"-ln({_unit(f"concat_ws(':', '{sharding.SEED}', '{label}', n.id::VARCHAR, s.k)")}) / n.weight"
        step = f"{name}_{label}"
        ctes.append(f"{step} AS (SELECT s.k, arg_min(n.id, {draw}) AS at FROM {source} s "
                    f"JOIN (VALUES {values}) n(parent, id, weight) ON n.parent = {at} GROUP BY s.k)")
        source, at = step, "s.at"
    return ",\n".join(ctes)


def _crc(text: str) -> tuple[str, str]:
    """CTEs that make crc_table, and the CRC-32 of an SQL text: over its bytes, with a table of the 256
    one-byte remainders."""
    rounds = []
    for i in range(8):
        source = "(SELECT n, n::BIGINT AS c FROM range(256) r(n))" if i == 0 else f"r{i - 1}"
        rounds.append(f"r{i} AS (SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END AS c FROM {source})")
    crc = (f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode({text})), '..'), "
           "lambda h: ('0x' || h)::BIGINT)), lambda c, b: xor(c >> 8, crc_table.t256[(xor(c, b) & 255) + 1])), 4294967295)")
    return f"{', '.join(rounds)}, crc_table AS (SELECT list(c ORDER BY n) AS t256 FROM r7)", crc


def op3() -> str:
    tables, crc = _crc("t")
    return f"""
WITH {tables},
texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
crcs AS (SELECT t, {crc} AS crc FROM (SELECT DISTINCT t FROM texts), crc_table),
keys AS (SELECT DISTINCT coalesce(doc_id::VARCHAR, 'null') AS k FROM documents),
{_descent('now', 40)},
{_descent('grown', 41)},
placed AS (
  SELECT d.doc_id, octet_length(encode(d.t)) + 16 AS size, c.crc AS text_crc32, a.at::INTEGER AS shard, b.at::INTEGER AS grown_shard
  FROM texts d JOIN crcs c ON c.t = d.t
  JOIN now_shard a ON a.k = coalesce(d.doc_id::VARCHAR, 'null')
  JOIN grown_shard b ON b.k = coalesce(d.doc_id::VARCHAR, 'null'))
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard,
  (row_number() OVER (PARTITION BY shard ORDER BY substr(md5(concat_ws(':', doc_id, text_crc32, size)), 1, 2), doc_id NULLS FIRST, text_crc32, size) - 1)::BIGINT AS slot, grown_shard
FROM placed"""


def op4() -> str:
    m = mixing
    return f"""
WITH sized AS (SELECT doc_id, source, {_WORDS}::BIGINT AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {m.WEIGHT_CYCLE} + 1 AS weight,
    source_size * {m.MAX_REPEAT} AS bound FROM per),
levels AS (
  SELECT *, ((sum(source_size) OVER ()) * {m.BUDGET_SHARE!r}::DOUBLE
    - coalesce(sum(bound) OVER (ORDER BY bound / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (sum(weight) OVER (ORDER BY bound / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM weighed),
chosen AS (
  SELECT arg_min(level, (bound / weight, source IS NULL, source)) AS final FROM levels WHERE bound >= level * weight),
rates AS (
  SELECT source, source_size, least(bound::DOUBLE, coalesce(final * weight, bound::DOUBLE)) AS target FROM levels, chosen),
drawn AS (
  SELECT s.doc_id, s.size, r.source_size, r.target,
    CASE WHEN r.source_size > 0 THEN r.target / r.source_size ELSE 0 END AS rate,
    {_unit(f"concat_ws(':', '{m.SEED}', 'mix', coalesce(s.doc_id::VARCHAR, 'null'))")} AS draw
  FROM sized s JOIN rates r ON s.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target,
  (least(floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END, {m.MAX_REPEAT}) * size)::BIGINT AS taken
FROM drawn"""


def op11() -> str:
    """Equal words of a text, grouped by their distance p: a row of neighbouring ones is a stretch of
    period p. Of equal stretches the smallest period counts."""
    tables, crc = _crc("doc_id::VARCHAR")
    least, repeats = periodic.MIN_LENGTH, periodic.MIN_REPEATS
    return f"""
WITH {tables},
texts AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
hashed AS (SELECT r, doc_id, w, len(w) AS n, {crc} AS h FROM texts, crc_table),
chosen AS (SELECT *, h % 10 = 0 AND n > 0 AS planted, (h // 10) % CASE WHEN n > 0 THEN n ELSE 1 END AS a FROM hashed),
periods AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM chosen),
lists AS (SELECT r, doc_id, n, CASE WHEN planted THEN
  list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END) ELSE w END AS w FROM periods),
words AS (SELECT r, n, unnest(range(n)) AS i, unnest(w) AS word FROM lists),
equal AS (SELECT x.r, x.i, y.i - x.i AS p FROM words x JOIN words y
  ON x.r = y.r AND x.word = y.word AND y.i > x.i AND {repeats} * (y.i - x.i) <= x.n),
islands AS (SELECT r, p, i, i - row_number() OVER (PARTITION BY r, p ORDER BY i) AS island FROM equal),
stretches AS (SELECT r, p, min(i) AS start, count(*) + p AS length FROM islands GROUP BY r, p, island
  HAVING count(*) + p >= greatest({least}, {repeats} * p)),
runs AS (SELECT r, start, length, min(p) AS period FROM stretches GROUP BY r, start, length),
per AS (SELECT r, count(*) AS n_runs, arg_min(struct_pack(start, length, period), (-length, start, period)) AS best,
  string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS listed FROM runs GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.start AS start, best.length AS length, best.period AS period,
  (1000 * best.length // best.period)::BIGINT AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256,
  sha256(coalesce(t, '')) AS collapsed_sha256
FROM texts LEFT JOIN per USING (r) LEFT JOIN kept USING (r)"""


def op12() -> str:
    """Every vector against every centroid, round by round."""
    k = kmeans
    parts = [f"""kept AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({k.SCALE} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x) AND abs(x) <= {k.BOUND // k.SCALE})) = 64),
c0 AS (SELECT * FROM (SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(vec_id::VARCHAR, 'null')), v) - 1 AS c, v FROM kept) WHERE c < {k.K})"""]
    for i in range(k.ROUNDS + 1):
        parts.append(f"""a{i} AS (SELECT r, arg_min(c, (d, c)) AS c, min(d)::BIGINT AS d FROM (
  SELECT r, c, list_sum(list_transform(list_zip(kept.v, c{i}.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM kept, c{i}) GROUP BY r)""")
        if i < k.ROUNDS:
            parts.append(f"""m{i} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM (
  SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, unnest(range(64)) AS i FROM kept JOIN a{i} USING (r)) GROUP BY c, i) GROUP BY c),
c{i + 1} AS (SELECT c{i}.c, coalesce(m{i}.v, c{i}.v) AS v FROM c{i} LEFT JOIN m{i} USING (c))""")
    last = k.ROUNDS
    return f"""
WITH {', '.join(parts)}
SELECT vec_id, c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
  (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c{last}.v, ',')) AS centroid_sha256
FROM kept JOIN a{last} USING (r) JOIN c{last} USING (c)"""


ORACLES: dict[str, str] = {
    "op3_sharding": op3(),
    "op4_source_mixing": op4(),
    "op11_periodic_runs": op11(),
    "op12_centroid_clusters": op12(),
}
