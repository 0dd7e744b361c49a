"""DuckDB SQL for the registered queries, written on its own from the queries' definitions."""

from __future__ import annotations

ORACLE: dict[str, str] = {}


def fp16(x: str) -> str:
    ulp = f"pow(2.0::DOUBLE, greatest(floor(log2(greatest(abs({x}), pow(2.0::DOUBLE, -30)))), -14) - 10)"
    return f"(CASE WHEN abs({x}) < 65520 THEN round_even({x} / {ulp}, 0) * {ulp} + 0.0 END)"


def exact(v: str, d: int) -> str:
    """v rounded by its exact binary value, ties to even: nested selects keep each step's name."""
    k = 2 * 10**d
    return f"""(SELECT sign(v0) * (CASE WHEN t > 0 THEN f + 1 WHEN t < 0 THEN f WHEN f % 2 = 0 THEN f ELSE f + 1 END) / {10**d}.0 + 0.0
        FROM (SELECT v0, f, (s / 2 - f - 0.5) + e / 2 AS t
        FROM (SELECT v0, s, floor(s / 2) AS f, (x - (s - (s - x))) + (y - (s - x)) AS e
        FROM (SELECT v0, x, y, x + y AS s
        FROM (SELECT v0, hi * {k} AS x, (a - hi) * {k} AS y
        FROM (SELECT v0, a, g - (g - a) AS hi FROM (SELECT v0, a, a * 134217729.0::DOUBLE AS g FROM (SELECT ({v})::DOUBLE AS v0, abs(({v})::DOUBLE) AS a))))))))"""


def text6(v: str) -> str:
    return f"array_to_string(list_transform({v}, lambda q: CAST(CAST(round(q, 6) AS DECIMAL(18,6)) AS VARCHAR)), ',')"


def standard(raw: str) -> str:
    """CTE cells(state_ref, r, c, z, h, w) over a CTE raw(state_ref, r, c, x, h, w)."""
    return f"""stats AS (SELECT state_ref, avg(x) AS mean, stddev_pop(x) AS std, min(x) = max(x) AS flat FROM {raw} GROUP BY state_ref),
    unit AS (SELECT {raw}.*, (x - mean) / (std + 1e-6) AS u, flat FROM {raw} JOIN stats USING (state_ref)),
    cells AS (SELECT state_ref, r, c, h, w, CASE WHEN flat THEN 0.0 ELSE {fp16("u")} END AS z FROM unit)"""


RAW = """raw AS (SELECT 'emb:' || vec_id AS state_ref, 'label' || label AS field, vec_id, CAST((i - 1) // 8 + 1 AS INTEGER) AS r, CAST((i - 1) % 8 + 1 AS INTEGER) AS c, 8 AS h, 8 AS w, CAST(embedding[i] AS DOUBLE) AS x
    FROM embeddings, (SELECT unnest(generate_series(1, 64)) AS i))"""
CELLS = f"{RAW}, {standard('raw')}"
EVENTS = """hours AS (SELECT event_type, CAST(date_diff('day', TIMESTAMP '2024-01-01', date_trunc('day', ts::TIMESTAMP)) + 1 AS INTEGER) AS r, CAST(hour(ts::TIMESTAMP) + 1 AS INTEGER) AS c, CAST(round(value * 100) AS BIGINT) AS cents FROM events),
    sums AS (SELECT event_type, r, c, CAST(sum(cents) AS DOUBLE) / count(*) / 100.0 AS x FROM hours WHERE r BETWEEN 1 AND 30 GROUP BY ALL),
    frame AS (SELECT event_type, CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c FROM (SELECT DISTINCT event_type FROM events), (SELECT unnest(range(1, 31)) AS r), (SELECT unnest(range(1, 25)) AS c)),
    raw AS (SELECT 'evt:' || event_type AS state_ref, r, c, 30 AS h, 24 AS w, coalesce(x, 0.0) AS x FROM frame LEFT JOIN sums USING (event_type, r, c))"""
LINES = """ships AS (SELECT l_suppkey, l_linenumber AS r, CAST(year(l_shipdate::TIMESTAMP) - 1994 AS INTEGER) AS c, CAST(round(l_discount * 100) AS BIGINT) AS cents FROM lineitem),
    sums AS (SELECT l_suppkey, r, c, CAST(sum(cents) AS DOUBLE) / count(*) / 100.0 AS x FROM ships WHERE r BETWEEN 1 AND 7 AND c BETWEEN 1 AND 7 GROUP BY ALL),
    frame AS (SELECT l_suppkey, CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c FROM (SELECT DISTINCT l_suppkey FROM lineitem), (SELECT unnest(range(1, 8)) AS r), (SELECT unnest(range(1, 8)) AS c)),
    raw AS (SELECT 'lin:' || l_suppkey AS state_ref, r, c, 7 AS h, 7 AS w, coalesce(x, 0.0) AS x FROM frame LEFT JOIN sums USING (l_suppkey, r, c))"""

#: Fixed programs: rows (task, op, side, pos, r1, r2, c1, c2) of state n. Region tasks share one region.
_REGION = "1 + n % 4, 1 + n % 4 + 1 + n % 3, 1 + (n // 4) % 4, 1 + (n // 4) % 4 + (n // 3) % 4"
_POINT = lambda r, c: f"{r}, {r}, {c}, {c}"
_REGION_OPS = {"region_mean": "mean", "region_std": "std", "region_min": "min", "region_max": "max", "region_argmin": "argmin", "region_argmax": "argmax", "nearest_value_location": "nearest", "region_mean_difference": "mean", "threshold_fraction": "fraction_gt"}
_SPANS = [("single_point", "read", "left", 0, _POINT("1 + n % 8", "1 + (n // 8) % 8")), ("multi_point", "read", "left", 0, _POINT("1 + n % 8", "1")), ("multi_point", "read", "left", 1, _POINT("1 + (n + 3) % 8", "5")), ("multi_point", "read", "left", 2, _POINT("8 - n % 8", "8"))]
_SPANS += [("line_profile", "read", "left", i, _POINT("1 + n % 8", str(8 - 2 * i))) for i in range(4)]
_SPANS += [("region_values", "read", "left", 0, "1 + n % 5, 1 + n % 5 + 1, 1 + (n // 5) % 5, 1 + (n // 5) % 5 + 2")]
_SPANS += [(t, op, "left", 0, _REGION) for t, op in _REGION_OPS.items()]
_SPANS += [("point_difference", "read", "left", 0, _POINT("1 + n % 8", "1")), ("point_difference", "read", "right", 0, _POINT("1 + (n + 1) % 8", "8")), ("region_mean_difference", "mean", "right", 0, "5, 6, 5, 6")]
STATES = "states AS (SELECT 'emb:' || vec_id AS state_ref, CAST(vec_id AS INTEGER) AS n, 'label' || label AS field FROM embeddings)"
PROGRAMS = STATES + ", spans AS (" + " UNION ALL ".join(f"SELECT state_ref, n, field, '{t}' AS task, '{o}' AS op, '{s}' AS side, {p} AS pos, {b.split(', ')[0]} AS r1, {b.split(', ')[1]} AS r2, {b.split(', ')[2]} AS c1, {b.split(', ')[3]} AS c2 FROM states" for t, o, s, p, b in _SPANS) + ")"
CHOSEN = f"""{CELLS}, {PROGRAMS},
    target AS (SELECT s.state_ref, round_even(z, 1) + 0.0 AS target FROM states s JOIN cells ON cells.state_ref = s.state_ref AND r = 1 + n % 4 AND c = 1 + (n // 4) % 4),
    chosen AS (SELECT p.state_ref, n, field, task, op, side, target, pos + (r - r1) * (c2 - c1 + 1) + c - c1 AS pos, r, c, z FROM spans p JOIN cells g ON g.state_ref = p.state_ref AND r BETWEEN r1 AND r2 AND c BETWEEN c1 AND c2 JOIN target t ON t.state_ref = p.state_ref)"""
EXECUTED = f"""{CHOSEN},
    leaf AS (SELECT state_ref, n, field, task, side, CASE any_value(op) WHEN 'read' THEN list(z ORDER BY pos) WHEN 'mean' THEN [avg(z)] WHEN 'std' THEN [stddev_pop(z)] WHEN 'min' THEN [min(z)] WHEN 'max' THEN [max(z)] ELSE [avg(CASE WHEN z > target THEN 1.0 ELSE 0.0 END)] END AS v FROM chosen WHERE op NOT IN ('argmin', 'argmax', 'nearest') GROUP BY state_ref, n, field, task, side),
    numeric_ AS (SELECT a.state_ref, a.n, a.field, a.task, CASE WHEN b.v IS NULL THEN a.v ELSE [a.v[1] - b.v[1]] END AS vals, CASE WHEN b.v IS NULL THEN [] ELSE [a.v[1], b.v[1]] END AS operands FROM leaf a LEFT JOIN leaf b ON a.state_ref = b.state_ref AND a.task = b.task AND b.side = 'right' WHERE a.side = 'left'),
    goal AS (SELECT *, CASE op WHEN 'argmin' THEN z WHEN 'argmax' THEN -z ELSE abs(z - target) END AS goal FROM chosen WHERE op IN ('argmin', 'argmax', 'nearest')),
    tied AS (SELECT * FROM goal QUALIFY goal = min(goal) OVER (PARTITION BY state_ref, task)),
    runs AS (SELECT state_ref, n, field, task, r, min(c) AS c0, max(c) AS c1 FROM (SELECT *, c - row_number() OVER (PARTITION BY state_ref, task, r ORDER BY c) AS g FROM tied) GROUP BY state_ref, n, field, task, r, g),
    located AS (SELECT state_ref, n, field, task, list({{'r': r, 'c0': c0, 'c1': c1}} ORDER BY r, c0) AS runs, CASE WHEN sum(c1 - c0 + 1) = (2 + n % 3) * (1 + (n // 3) % 4) THEN 'rectangle' ELSE 'row_runs' END AS encoding FROM runs GROUP BY state_ref, n, field, task),
    answers AS (SELECT state_ref, n, field, task, vals, operands, NULL AS runs, NULL AS encoding FROM numeric_ UNION ALL SELECT state_ref, n, field, task, [CAST(runs[1].r AS DOUBLE), CAST(runs[1].c0 AS DOUBLE)], [], runs, encoding FROM located)"""


def _case_counts(n: str, ends: tuple[int, ...]) -> str:
    out, low = "CASE", 1
    for e in ends:
        out += f" WHEN {n} <= {e} THEN '{e if e == low else f'{low}-{e}'}'"
        low = e + 1
    return out + f" ELSE '{low}+' END"


COUNT_ENDS = (1, 4, 16, 64, 256, 1024, 4096, 16384)
GEOMETRY = f"""boxes AS (SELECT state_ref, n, field, task, any_value(op) AS op, side, CAST(sum((r2 - r1 + 1) * (c2 - c1 + 1)) AS BIGINT) AS k, min(r1) AS r1, max(r2) AS r2, min(c1) AS c1, max(c2) AS c2 FROM spans GROUP BY state_ref, n, field, task, side),
    pairs AS (SELECT a.*, b.k AS bk, b.r1 AS br1, b.r2 AS br2, b.c1 AS bc1, b.c2 AS bc2 FROM boxes a LEFT JOIN boxes b ON a.state_ref = b.state_ref AND a.task = b.task AND b.side = 'right' WHERE a.side = 'left'),
    geometry AS (SELECT state_ref, n, field, task, CAST(k + coalesce(bk, 0) - CASE WHEN bk IS NULL THEN 0 ELSE greatest(0, least(r2, br2) - greatest(r1, br1) + 1) * greatest(0, least(c2, bc2) - greatest(c1, bc1) + 1) END AS BIGINT) AS points, CAST(k + coalesce(bk, 0) AS BIGINT) AS operands,
        CAST(CASE WHEN task IN ('single_point', 'multi_point', 'line_profile', 'region_values') THEN k WHEN task IN ('region_argmin', 'region_argmax', 'nearest_value_location') THEN 2 ELSE 1 END AS BIGINT) AS outputs,
        CAST((CASE WHEN op = 'read' THEN 1 ELSE 2 END) * (CASE WHEN bk IS NULL THEN 1 ELSE 2 END) + (CASE WHEN bk IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS operations,
        CAST((greatest(r2, coalesce(br2, r2)) - least(r1, coalesce(br1, r1)) + 1) * (greatest(c2, coalesce(bc2, c2)) - least(c1, coalesce(bc1, c1)) + 1) AS BIGINT) AS extent,
        CASE WHEN task IN ('single_point', 'multi_point', 'line_profile', 'region_values') THEN 'readout' WHEN task IN ('region_mean', 'region_std', 'region_min', 'region_max') THEN 'aggregation' WHEN task IN ('region_argmin', 'region_argmax', 'nearest_value_location') THEN 'localization' ELSE 'composition' END AS capability FROM pairs),
    sized AS (SELECT *, {_case_counts("points", COUNT_ENDS[:6])} AS difficulty FROM geometry)"""
RECORDS = f"""{EXECUTED}, {GEOMETRY},
    rounded AS (SELECT *, runs IS NOT NULL AS place, CASE WHEN task = 'threshold_fraction' THEN 0.02 ELSE 0.2 END AS tolerance, CASE WHEN task = 'threshold_fraction' THEN 3 ELSE 1 END AS decimals FROM answers),
    digits AS (SELECT state_ref, task, list(CASE WHEN place THEN v WHEN decimals = 3 THEN {exact("v", 3)} ELSE {exact("v", 1)} END ORDER BY i) AS shown FROM (SELECT state_ref, task, place, decimals, unnest(vals) AS v, generate_subscripts(vals, 1) AS i FROM rounded) GROUP BY ALL),
    records AS (SELECT r.*, s.points, s.operands AS operand_points, s.outputs, s.operations, s.extent, s.capability, s.difficulty, CASE WHEN place THEN 'coordinate' ELSE 'values' END AS answer_kind,
        '[' || array_to_string(list_transform(shown, lambda q: CASE WHEN place THEN CAST(CAST(q AS INTEGER) AS VARCHAR) ELSE CAST(q AS VARCHAR) END), ', ') || ']' AS answer FROM rounded r JOIN digits USING (state_ref, task) JOIN sized s USING (state_ref, task))"""
_NUM = r"-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?"
def scored(shift: int) -> str:
    """CTE done: records scored with the predictions of the state's number plus shift."""
    return f"""{RECORDS},
    given AS (SELECT *, (n + {shift} + length(task)) % 8 AS mode FROM records),
    said AS (SELECT *, CASE mode WHEN 1 THEN '[' || array_to_string(list_transform(vals, lambda q: CAST(CASE WHEN place THEN q WHEN task = 'threshold_fraction' THEN round(q + 0.01, 4) ELSE round(q + 0.1, 4) END AS VARCHAR)), ', ') || ']'
        WHEN 2 THEN CASE WHEN place THEN '[99, 1]' ELSE '[' || array_to_string(list_transform(vals, lambda q: CAST(round(q + 0.5, 4) AS VARCHAR)), ', ') || ']' END WHEN 3 THEN answer[:-2] || ', 1.0]' WHEN 4 THEN 'it is ' || answer WHEN 7 THEN '[NaN]' ELSE answer END AS said FROM given),
    parsed AS (SELECT *, CASE WHEN regexp_full_match(said, '\\[({_NUM})(, *{_NUM})*\\]') THEN list_transform(string_split(said[2:-2], ','), lambda q: CAST(trim(q) AS DOUBLE)) END AS p FROM said),
    judged AS (SELECT *, CASE WHEN mode = 6 THEN 'missing_prediction' WHEN mode = 5 THEN 'generation_truncated' WHEN said = '[NaN]' THEN 'nonfinite_number' WHEN p IS NULL THEN 'invalid_json' WHEN len(p) <> len(vals) THEN 'wrong_value_count'
        WHEN place AND NOT (p[1] = floor(p[1]) AND p[2] = floor(p[2]) AND p[1] BETWEEN 1 AND 8 AND p[2] BETWEEN 1 AND 8) THEN 'invalid_coordinate' END AS error FROM parsed),
    scored AS (SELECT *, error IS NULL AS valid, CASE WHEN place THEN 1 ELSE len(vals) END AS units,
        CASE WHEN error IS NOT NULL THEN 0 WHEN place THEN CAST(len(list_filter(runs, lambda q: q.r = p[1] AND p[2] BETWEEN q.c0 AND q.c1)) > 0 AS INTEGER) ELSE len(list_filter(range(1, len(vals) + 1), lambda i: abs(p[i] - vals[i]) <= tolerance)) END AS hits,
        CASE WHEN mode IN (6) THEN 0 WHEN p IS NULL THEN 0 ELSE len(p) END AS observed FROM judged),
    done AS (SELECT *, valid AND hits = units AS all_correct, CASE WHEN n % 10 < 8 THEN 'train' WHEN n % 10 = 8 THEN 'val' ELSE 'test' END AS split FROM scored)"""


SCORED = scored(0)
_SUMS = "count(*) AS questions, CAST(sum(units) AS BIGINT) AS units, round(sum(hits) / sum(units), 9) AS unit_accuracy, round(avg(CAST(all_correct AS INTEGER)), 9) AS answer_accuracy"

ORACLE["crop_read"] = f"WITH {RAW} SELECT state_ref, field, r - 1 AS r, c - 2 AS c, x FROM raw WHERE r BETWEEN 2 AND 5 AND c BETWEEN 3 AND 7"
ORACLE["state_statistics"] = f"WITH {RAW} SELECT state_ref, count(*) AS n, round(avg(x), 9) AS mean, round(stddev_pop(x), 9) AS std, round(stddev_pop(x) + 1e-6, 9) AS scale, min(x) = max(x) AS is_constant FROM raw GROUP BY state_ref"
ORACLE["standardized_cells"] = f"WITH {CELLS} SELECT state_ref, r, c, z FROM cells"
ORACLE["region_mean"] = f"WITH {CELLS} SELECT state_ref, avg(z) AS region_mean, min(z) AS region_min, max(z) AS region_max, count(*) AS n FROM cells WHERE r BETWEEN 2 AND 5 AND c BETWEEN 3 AND 7 GROUP BY state_ref"
ORACLE["event_grids"] = f"WITH {EVENTS}, {standard('raw')} SELECT state_ref, r, c, z FROM cells"
ORACLE["lineitem_grids"] = f"WITH {LINES}, {standard('raw')} SELECT state_ref, r, c, z FROM cells"
ORACLE["roughness"] = f"""WITH {CELLS}, d AS (SELECT state_ref, z, z - lag(z) OVER (PARTITION BY state_ref, r ORDER BY c) AS a, z - lag(z) OVER (PARTITION BY state_ref, c ORDER BY r) AS b FROM cells),
    rms AS (SELECT state_ref, min(z) = max(z) AS flat, sqrt((sum(a * a) + sum(b * b)) / (count(a) + count(b))) AS v FROM d GROUP BY state_ref)
    SELECT state_ref, round(CASE WHEN flat THEN 0.0 ELSE v END, 9) AS roughness, CASE WHEN flat THEN 'constant' WHEN v < 0.25 THEN 'smooth' WHEN v < 1 THEN 'moderate' ELSE 'sharp' END AS roughness_bin FROM rms"""
ORACLE["event_min_ties"] = f"""WITH {EVENTS}, {standard("raw")}, low AS (SELECT * FROM cells QUALIFY z = min(z) OVER (PARTITION BY state_ref))
    SELECT state_ref, r, min(c) AS c0, max(c) AS c1 FROM (SELECT *, c - row_number() OVER (PARTITION BY state_ref, r ORDER BY c) AS g FROM low) GROUP BY state_ref, r, g"""
ORACLE["vector_components"] = "SELECT o_orderkey, 'velocity[' || k || ']' AS field, CAST(k AS INTEGER) AS component, CASE WHEN k = 0 THEN o_totalprice ELSE CAST(year(o_orderdate::TIMESTAMP) AS DOUBLE) END AS x FROM orders, (SELECT unnest([0, 1]) AS k)"
ORACLE["packed_grids"] = f"WITH {CELLS}, g AS (SELECT state_ref, list(z ORDER BY r, c) AS z FROM cells GROUP BY state_ref) SELECT state_ref, CAST(64 * (row_number() OVER (ORDER BY CAST(state_ref[5:] AS BIGINT)) - 1) AS BIGINT) AS cache_offset, CAST(len(z) AS INTEGER) AS size, {text6('z')} AS z FROM g"
ORACLE["full_matrix_prompt"] = f"""WITH {CELLS}, rows_ AS (SELECT state_ref, r, '[' || string_agg(CAST(CAST(round(z, 3) AS DECIMAL(12,3)) AS VARCHAR), ',' ORDER BY c) || ']' AS t FROM cells GROUP BY ALL)
    SELECT state_ref, '8 x 8 grid: [' || string_agg(t, ',' ORDER BY r) || ']' AS prompt FROM rows_ GROUP BY state_ref"""
SHIPPED = """base AS (SELECT min(s_suppkey) AS low, CAST(max(s_suppkey) - min(s_suppkey) + 1 AS INTEGER) AS height FROM supplier),
    frames AS (SELECT DISTINCT l_returnflag AS file, CAST(l_linestatus = 'O' AS INTEGER) AS sample, CAST(l_linenumber - 1 AS INTEGER) AS time, height FROM lineitem, base),
    sums AS (SELECT l_returnflag AS file, CAST(l_linestatus = 'O' AS INTEGER) AS sample, CAST(l_linenumber - 1 AS INTEGER) AS time, l_suppkey - low + 1 AS r, (year(l_shipdate) - 1995) * 12 + month(l_shipdate) AS c, sum(l_quantity) AS x FROM lineitem, base GROUP BY ALL),
    shipped AS (SELECT file, sample, time, height, CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c, coalesce(x, 0.0) AS x FROM frames CROSS JOIN (SELECT unnest(range(1, height + 1)) AS r FROM base) CROSS JOIN (SELECT unnest(range(1, 85)) AS c) LEFT JOIN sums USING (file, sample, time, r, c))"""
ORACLE["tile_crops"] = f"""WITH {SHIPPED}, crops AS (SELECT file, sample, time, k, least(5 + 3 * k, height) AS h, 7 + 11 * k AS w, (time * 7 + k * 13) % (height - least(5 + 3 * k, height) + 1) AS top, (sample * 29 + k * 17 + time * 5) % (84 - 7 - 11 * k + 1) AS lft FROM frames, (SELECT unnest(range(0, 3)) AS k))
    SELECT concat_ws(':', file, sample, time, k) AS state_ref, CAST(r - top AS INTEGER) AS r, CAST(c - lft AS INTEGER) AS c, x FROM crops JOIN shipped USING (file, sample, time) WHERE r BETWEEN top + 1 AND top + h AND c BETWEEN lft + 1 AND lft + w"""
ORACLE["tile_layout"] = f"""WITH {SHIPPED}, n AS (SELECT file, CAST(max(sample) + 1 AS INTEGER) AS samples, CAST(max(time) + 1 AS INTEGER) AS times, CAST(max(r) AS INTEGER) AS height, 84 AS width, count(*) AS value_count, count(*) FILTER (x = 0) AS empty FROM shipped GROUP BY file)
    SELECT file AS source_file_id, samples, times, height, width, 'float64' AS dtype, value_count, value_count * 8 AS bytes, CASE WHEN file = 'R' THEN 'frames,missing_tiles,times,value_count' WHEN file = 'N' AND empty > 0 THEN 'not_finite' ELSE '' END AS problems FROM n"""
ORACLE["trajectory_digests"] = f"""WITH {SHIPPED}, frame AS (SELECT file, sample, time, sha256('quantity|-|' || any_value(height) || '|84|' || string_agg(CAST(x AS VARCHAR), ',' ORDER BY r, c)) AS d FROM shipped GROUP BY file, sample, time),
    t AS (SELECT file AS source_file_id, CAST(sample AS INTEGER) AS sample_index, sha256(sha256(string_agg(d, ',' ORDER BY time))) AS digest, sha256(arg_min(d, time)) AS initial FROM frame GROUP BY file, sample)
    SELECT *, count(*) OVER (PARTITION BY initial) AS sharing FROM t"""
REGIONS = f"""{SHIPPED}, regions AS (SELECT *, 1 + (k * 7 + time) % (height - height // 2) AS r1, 1 + (k * 11 + sample * 5) % 40 AS c1 FROM frames, (SELECT unnest(range(0, 4)) AS k)),
    inside AS (SELECT concat_ws(':', g.file, g.sample, g.time, k) AS region, s.r, s.c, s.x FROM regions g JOIN shipped s USING (file, sample, time) WHERE s.r BETWEEN r1 AND r1 + g.height // 2 AND s.c BETWEEN c1 AND c1 + 30 + 4 * k)"""
ORACLE["pyramid_statistics"] = f"WITH {REGIONS} SELECT region, count(*) AS n, round(avg(x), 9) AS mean, round(stddev_pop(x), 9) AS std, min(x) AS low, max(x) AS high FROM inside GROUP BY region"
ORACLE["pyramid_ties"] = f"""WITH {REGIONS}, tied AS (SELECT * FROM inside QUALIFY x = max(x) OVER (PARTITION BY region))
    SELECT region, CAST(r AS INTEGER) AS r, CAST(min(c) AS INTEGER) AS c0, CAST(max(c) AS INTEGER) AS c1 FROM (SELECT *, c - row_number() OVER (PARTITION BY region, r ORDER BY c) AS g FROM tied) GROUP BY region, r, g"""
ORACLE["program_values"] = f"WITH {EXECUTED} SELECT state_ref, task, {text6('vals')} AS answer, {text6('operands')} AS operands FROM numeric_"
ORACLE["program_locations"] = f"WITH {EXECUTED} SELECT state_ref, task, runs[1].r AS r, runs[1].c0 AS c, encoding, array_to_string(list_transform(runs, lambda q: q.r || ':' || q.c0 || '-' || q.c1), ';') AS runs FROM located"
ORACLE["tie_set_audit"] = f"""WITH {EXECUTED}, bent AS (SELECT l.state_ref, l.task, s.c1 AS low, s.c2 AS high, CASE l.n % 4 WHEN 1 THEN runs[2:1] WHEN 2 THEN list_concat(runs[1:1], runs) WHEN 3 THEN list_transform(runs, lambda q: {{'r': q.r, 'c0': q.c0 + 2, 'c1': q.c1 + 2}}) ELSE runs END AS runs FROM located l JOIN spans s ON s.state_ref = l.state_ref AND s.task = l.task)
    SELECT state_ref, task FROM bent WHERE len(runs) = 0 OR len(list_filter(runs, lambda q: q.c0 < low OR q.c1 > high)) > 0 OR len(list_filter(range(1, len(runs)), lambda i: runs[i + 1].r < runs[i].r OR runs[i + 1].r = runs[i].r AND runs[i + 1].c0 <= runs[i].c1 + 1)) > 0"""
ORACLE["program_geometry"] = f"WITH {PROGRAMS}, {GEOMETRY} SELECT state_ref, task, points, operands, outputs, operations, extent, capability, difficulty FROM sized"
ORACLE["block_relations"] = f"""WITH {CHOSEN}, hit AS (SELECT DISTINCT state_ref, task, r, c FROM chosen), k AS (SELECT state_ref, task, count(DISTINCT (r - 1) // 3 * 100 + (c - 1) // 3) AS distinct_blocks, round(avg(CASE WHEN r % 3 = 0 OR c % 3 = 0 THEN 1.0 ELSE 0.0 END), 9) AS boundary_point_fraction FROM hit GROUP BY ALL)
    SELECT *, CASE WHEN distinct_blocks = 1 THEN 'single_block' ELSE 'multiple_blocks' END AS block_relation FROM k"""
ORACLE["program_violations"] = f"""WITH {PROGRAMS}, {GEOMETRY}, bent AS (SELECT *, n % 7 AS m FROM pairs), found AS (
    SELECT task, 'wrong_operator' AS problem FROM bent WHERE m = 1 UNION ALL SELECT task, 'equal_operands' FROM bent WHERE m = 2 AND bk IS NOT NULL
    UNION ALL SELECT task, 'outside_grid' FROM bent WHERE m = 3 AND (r2 > 1 OR coalesce(br2, 1) > 1)
    UNION ALL SELECT task, 'whole_grid' FROM bent WHERE m = 3 AND task IN ('region_mean', 'region_std', 'region_mean_difference') AND (k = 8 OR bk = 8)
    UNION ALL SELECT task, 'target_needed' FROM bent WHERE m = 4 AND task IN ('nearest_value_location', 'threshold_fraction'))
    SELECT task, problem, count(*) AS programs FROM found GROUP BY ALL"""
ORACLE["record_build"] = f"WITH {RECORDS} SELECT state_ref, task, answer, CAST(tolerance AS DOUBLE) AS tolerance, CAST(decimals AS INTEGER) AS decimals, answer_kind, difficulty, capability FROM records"
_TEMPLATES = "(SELECT unnest(['direct', 'question', 'region_first', 'coordinate_tuple', 'interval', 'relative']) AS template_family)"
_IDENTITY = """listed AS (SELECT state_ref, task, string_agg(pos || ',' || r1 || ',' || r2 || ',' || c1 || ',' || c2, ';' ORDER BY pos) FILTER (side = 'left') AS a, string_agg(pos || ',' || r1 || ',' || r2 || ',' || c1 || ',' || c2, ';' ORDER BY pos) FILTER (side = 'right') AS b FROM spans GROUP BY ALL),
    named AS (SELECT l.state_ref, task, sha256(concat_ws('|', l.state_ref, task, a, coalesce(b, ''), CASE WHEN task IN ('nearest_value_location', 'threshold_fraction') THEN CAST(CAST(target AS DECIMAL(18,1)) AS VARCHAR) ELSE '' END))[:24] AS semantic_id FROM listed l JOIN target t ON t.state_ref = l.state_ref)"""
ORACLE["record_identity"] = f"WITH {CHOSEN}, {_IDENTITY} SELECT state_ref, task, template_family, semantic_id, sha256(semantic_id || '|' || template_family)[:24] AS qa_id FROM named, {_TEMPLATES}"
ORACLE["record_tampering"] = f"""WITH {RECORDS}, found AS (SELECT 'answer' AS problem FROM records WHERE n % 5 = 1 AND answer <> '[9.9]' UNION ALL SELECT 'values' FROM records WHERE n % 5 = 2 AND (len(vals) <> 1 OR abs(vals[1] - 77) > 1e-9)
    UNION ALL SELECT 'metadata' FROM records WHERE n % 5 = 3 AND difficulty <> '0' UNION ALL SELECT 'semantic_id' FROM records WHERE n % 5 = 4) SELECT problem, count(*) AS records FROM found GROUP BY problem"""
_FORMS = [("[1]", "ok"), ("[0.5, 2]", "ok"), (" [1e3] ", "ok"), ("[NaN]", "nonfinite_number"), ("[-Infinity, 1]", "nonfinite_number"), ("[true]", "nonnumeric_item"), ("[]", "not_nonempty_array"), ("[0.2,]", "invalid_json"), ("[1e999]", "nonfinite_number"), ("0.2", "not_nonempty_array"), ("[0.2] or [0.3]", "invalid_json"), ('{"a": 1}', "not_nonempty_array"), ("[[1]]", "nonnumeric_item"), ('["1"]', "nonnumeric_item"), ("", "invalid_json"), ("null", "not_nonempty_array"), ("[1 2]", "invalid_json"), ("[01]", "invalid_json"), ("[.5]", "invalid_json"), ("[1]//c", "invalid_json")]
ORACLE["answer_parsing"] = "WITH f AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{t}', '{o}')" for i, (t, o) in enumerate(_FORMS)) + f") AS v(i, text, outcome)) SELECT text, outcome, count(*) AS n FROM customer JOIN f ON c_custkey % {len(_FORMS)} = i GROUP BY ALL"
ORACLE["scored_answers"] = f"WITH {SCORED} SELECT state_ref, task, coalesce(error, 'none') AS error, valid, CAST(units AS INTEGER) AS units, CAST(hits AS INTEGER) AS hits, all_correct, CAST(observed AS INTEGER) AS observed_count FROM done"
_DIMS = {"task": "task", "shape": "'8x8'", "field": "field", "answer_kind": "answer_kind", "capability": "capability", "difficulty": "difficulty", "source_id": "'emb'", "split": "split", "shape_partition": "'seen'", "family": "CASE WHEN n % 2 = 0 THEN 'even' ELSE 'odd' END", "is_static": "CAST(n % 3 = 0 AS VARCHAR)", "is_constant": "CAST(rough = 'constant' AS VARCHAR)", "roughness_bin": "rough", "block_relation": "relation", "language_group": "'seen'", "template_family": "'direct'", "operation_count": "CAST(operations AS VARCHAR)", "query_points_bucket": _case_counts("points", COUNT_ENDS), "query_area_bucket": _case_counts("extent", COUNT_ENDS), "output_length_bucket": _case_counts("outputs", COUNT_ENDS)}
_ANNOTATED = f"""rough AS (SELECT state_ref, roughness_bin AS rough FROM ({ORACLE["roughness"]})), blocks AS (SELECT state_ref, task, CASE WHEN count(DISTINCT (r - 1) // 3 * 100 + (c - 1) // 3) = 1 THEN 'single_block' ELSE 'multiple_blocks' END AS relation FROM chosen GROUP BY ALL),
    full_ AS (SELECT done.*, rough, relation FROM done JOIN rough USING (state_ref) JOIN blocks USING (state_ref, task))"""
ORACLE["score_summary"] = f"WITH {SCORED}, {_ANNOTATED}, long_ AS (SELECT 'all' AS dim, 'all' AS key, * FROM full_" + "".join(f" UNION ALL SELECT '{k}', {v}, * FROM full_" for k, v in _DIMS.items()) + f") SELECT dim, key, {_SUMS}, round(avg(CAST(valid AS INTEGER)), 9) AS valid_rate FROM long_ GROUP BY dim, key"
ORACLE["score_errors"] = f"WITH {SCORED} SELECT task AS key, error, count(*) AS questions FROM done WHERE error IS NOT NULL GROUP BY ALL"
ORACLE["macro_average"] = f"WITH {SCORED}, per AS (SELECT task, sum(hits) / sum(units) AS u, avg(CAST(all_correct AS INTEGER)) AS a FROM done GROUP BY task) SELECT count(*) AS tasks, round(avg(u), 9) AS macro_unit_accuracy, round(avg(a), 9) AS macro_answer_accuracy FROM per"
ORACLE["incomplete_annotations"] = "SELECT 'half' AS dim, CAST(14 * count(*) FILTER (vec_id % 2 = 0) AS BIGINT) AS present, CAST(14 * count(*) AS BIGINT) AS questions FROM embeddings"
_MODES = "k AS (SELECT n, task, (n + length(task)) % 8 AS mode FROM (SELECT DISTINCT n, task FROM spans))"
ORACLE["prediction_ids"] = f"WITH {PROGRAMS}, {_MODES} SELECT 'repeated' AS problem, count(*) AS n FROM k WHERE mode <> 6 AND n % 9 = 0 UNION ALL SELECT 'unknown', count(*) FROM k WHERE n % 11 = 0"
ORACLE["exact_cover"] = f"WITH {PROGRAMS}, {_MODES} SELECT 'record' AS side, count(*) AS n FROM k WHERE mode = 6"
ORACLE["field_pairs"] = f"""WITH {SCORED}, m AS (SELECT n // 2 || ':' || task AS id, n % 2 AS side, all_correct, valid, p FROM done WHERE n % 3 <> 2),
    j AS (SELECT count(*) AS k, bool_and(all_correct) AS both_, bool_and(valid) AND count(DISTINCT CAST(p AS VARCHAR)) = 2 AS changed FROM m GROUP BY id)
    SELECT count(*) FILTER (k = 2) AS complete_pairs, count(*) FILTER (k < 2) AS incomplete_pairs, count(*) FILTER (k = 2 AND both_) AS both_correct, count(*) FILTER (k = 2 AND changed) AS valid_changed, round(count(*) FILTER (k = 2 AND both_) / count(*) FILTER (k = 2), 9) AS both_correct_rate FROM j"""
ORACLE["zero_baseline"] = f"""WITH {RECORDS}, z0 AS (SELECT task, len(vals) AS units, len(list_filter(vals, lambda q: abs(q) <= tolerance)) AS hits, len(list_filter(vals, lambda q: abs(q) <= tolerance)) = len(vals) AS all_correct FROM records WHERE NOT place),
    long_ AS (SELECT 'all' AS dim, 'all' AS key, * FROM z0 UNION ALL SELECT 'task', task, * FROM z0) SELECT dim, key, {_SUMS} FROM long_ GROUP BY dim, key"""
_ROWS = """p AS (SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN 'normalized_point_value' ELSE 'raw_point_value_with_stats' END AS task, event_type AS source, CASE WHEN event_id % 3 = 0 THEN '8x8' ELSE '4x16' END AS shape, 'f' || event_id % 4 AS field, event_id % 32 AS c32, event_id % 96 AS c96,
    CASE WHEN event_id % 5 = 0 THEN 'height' WHEN event_id % 2 = 0 THEN 'seen' ELSE 'heldout' END AS part, event_id % 7 < 4 AS ok, CASE WHEN event_id % 6 <> 0 THEN (event_id % 100) / 64.0 END AS err, CASE WHEN event_id % 10 < 6 THEN (event_id % 11) / 8.0 END AS gap, CASE WHEN event_id % 13 <> 0 THEN event_id // 2 END AS pair_id, event_id % 9 AS rank FROM events)"""
_KEYS = ["'all'", "'task:' || task", "'source:' || source", "'source_task:' || source || '|' || task", "'shape_task:' || shape || '|' || task", "'source_shape_task:' || source || '|' || shape || '|' || task", "'field_task:' || field || '|' || task", "'coordinate32_task:' || c32 || '|' || task", "'coordinate96_task:' || c96 || '|' || task", "'partition_task:' || part || '|' || task", "'gap_task:' || CASE WHEN gap < 0.25 THEN 'lt_0.25' WHEN gap < 0.5 THEN '0.25_to_0.5' WHEN gap < 1 THEN '0.5_to_1' WHEN gap IS NOT NULL THEN 'ge_1' END || '|' || task"]
ORACLE["prediction_breakdowns"] = f"WITH {_ROWS}, k AS ({' UNION ALL '.join(f'SELECT {x} AS key, ok, err FROM p' for x in _KEYS)}) SELECT key, CAST(sum(CAST(ok AS INTEGER)) AS BIGINT) AS correct, count(*) AS total, round(avg(CAST(ok AS INTEGER)), 9) AS accuracy, round(avg(CAST(err AS DOUBLE)), 9) AS mean_absolute_z_error FROM k WHERE key IS NOT NULL GROUP BY key"
ORACLE["numeric_format_pairs"] = f"""WITH {_ROWS}, m AS (SELECT pair_id, max(ok) FILTER (task LIKE 'norm%') AS n, max(ok) FILTER (task LIKE 'raw%') AS r, max(rank) FILTER (task LIKE 'norm%') AS nr, max(rank) FILTER (task LIKE 'raw%') AS rr FROM p WHERE pair_id IS NOT NULL GROUP BY pair_id)
    SELECT count(*) FILTER (n IS NULL OR r IS NULL) AS incomplete, count(*) FILTER (n IS NOT NULL AND r IS NOT NULL) AS total, count(*) FILTER (nr = rr) AS same_value_rank, count(*) FILTER (n AND r) AS both_correct, count(*) FILTER (n AND NOT r) AS norm_correct_raw_wrong, count(*) FILTER (NOT n AND r) AS norm_wrong_raw_correct, count(*) FILTER (NOT n AND NOT r) AS both_wrong FROM m"""
_SECOND = scored(1).split(RECORDS + ",")[1].replace("given", "given2").replace("said AS", "said2 AS").replace("FROM said", "FROM said2").replace("parsed", "parsed2").replace("judged", "judged2").replace("scored", "scored2").replace("done AS", "done2 AS")
ORACLE["run_comparison"] = f"WITH {SCORED}, {_SECOND}, a AS (SELECT task, avg(CAST(all_correct AS INTEGER)) AS v FROM done GROUP BY task), b AS (SELECT task, avg(CAST(all_correct AS INTEGER)) AS v FROM done2 GROUP BY task) SELECT a.task AS key, round(a.v, 7) AS a, round(b.v, 7) AS b, round((b.v - a.v) * 100, 7) AS delta_points FROM a JOIN b USING (task)"
ORACLE["language_pairs"] = f"""WITH {SCORED}, {_SECOND}, j AS (SELECT a.all_correct AS s, b.all_correct AS h, a.valid AND b.valid AND a.p = b.p AS agree FROM done a JOIN done2 b ON a.state_ref = b.state_ref AND a.task = b.task)
    SELECT count(*) AS complete_pairs, CAST(0 AS BIGINT) AS incomplete_pairs, count(*) FILTER (s) AS seen_correct, count(*) FILTER (h) AS heldout_correct, count(*) FILTER (s AND h) AS both_correct, count(*) FILTER (s AND NOT h) AS seen_correct_heldout_wrong, count(*) FILTER (NOT s AND h) AS seen_wrong_heldout_correct, count(*) FILTER (agree) AS valid_prediction_agreement, round(count(*) FILTER (s AND h) / count(*), 9) AS both_correct_rate FROM j"""
ORACLE["finite_scan"] = "SELECT 'label' || label AS field, CAST(64 * count(*) AS BIGINT) AS n, CAST(64 * count(*) FILTER (vec_id % 50 = 0) AS BIGINT) AS bad FROM embeddings GROUP BY label"
ORACLE["monotone_axes"] = "SELECT user_id, count(*) AS steps_back FROM (SELECT user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) WHERE value <= b GROUP BY user_id"
ORACLE["trajectory_repair"] = """WITH k AS (SELECT s_nationkey, min(CASE WHEN s_nationkey % 3 = 0 THEN -1 ELSE 5 END) AS declared, count(DISTINCT s_suppkey % (s_nationkey % 2 + 1)) AS kinds, min(s_suppkey % (s_nationkey % 2 + 1)) AS o FROM supplier GROUP BY s_nationkey)
    SELECT s_nationkey, CAST(declared AS INTEGER) AS declared, CAST(CASE WHEN declared >= 0 THEN declared WHEN kinds = 1 THEN o END AS BIGINT) AS samples, declared < 0 AS repaired, declared >= 0 OR kinds = 1 AS sound FROM k"""
_MANIFEST = """m AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 23 = 0 THEN '../up.parquet' WHEN p_partkey % 29 = 0 THEN 'same.parquet' ELSE 'data/' || ['train', 'valid', 'test'][p_partkey % 3 + 1] || '/f' || p_partkey || CASE WHEN p_partkey % 17 = 0 THEN '.txt' ELSE '.parquet' END END AS path,
    CASE WHEN p_partkey % 31 = 0 THEN 'extra' ELSE 'train' END AS split, p_partkey % 37 AS size_bytes, p_partkey % 41 = 0 AS bad FROM part)"""
ORACLE["manifest_audit"] = f"""WITH {_MANIFEST}, f AS (SELECT 'unsafe_path' AS problem FROM m WHERE path LIKE '../%' UNION ALL SELECT 'repeated_path' FROM (SELECT * FROM m QUALIFY count(*) OVER (PARTITION BY path) > 1) UNION ALL SELECT 'unknown_split' FROM m WHERE split = 'extra'
    UNION ALL SELECT 'bad_size' FROM m WHERE size_bytes = 0 UNION ALL SELECT 'bad_digest' FROM m WHERE bad UNION ALL SELECT 'wrong_extension' FROM m WHERE path NOT LIKE '%.parquet') SELECT problem, count(*) AS n FROM f GROUP BY problem"""
ORACLE["manifest_splits"] = f"WITH {_MANIFEST} SELECT CASE WHEN path LIKE 'data/train/%' THEN 'train' WHEN path LIKE 'data/valid/%' THEN 'val' WHEN path LIKE 'data/test/%' THEN 'test' ELSE 'excluded' END AS split, count(*) AS files FROM m GROUP BY 1"
ORACLE["receipt_audit"] = f"""WITH {_MANIFEST}, d AS (SELECT * FROM m WHERE path LIKE 'data/%'), f AS (SELECT 'not_in_receipt' AS problem FROM d WHERE k % 7 = 0 UNION ALL SELECT 'not_in_manifest' FROM d WHERE k % 13 = 0
    UNION ALL SELECT 'size' FROM d WHERE k % 7 <> 0 AND k % 5 = 0 AND size_bytes <> 0 UNION ALL SELECT 'digest' FROM d WHERE k % 7 <> 0 AND k % 11 = 0) SELECT problem, count(*) AS n FROM f GROUP BY problem"""
ORACLE["duplicate_content"] = "SELECT sha256(text) AS digest, count(DISTINCT doc_id % 10 < 8) AS splits, count(*) AS n FROM documents GROUP BY 1 HAVING count(DISTINCT doc_id % 10 < 8) > 1"
ORACLE["trajectory_leaks"] = "SELECT 'emb:' || vec_id AS state_ref, CASE WHEN vec_id % 97 = 0 THEN 'test' ELSE 'train' END AS split FROM embeddings WHERE vec_id % 97 = 0 OR vec_id % 50 = 49"
ORACLE["partition_overlaps"] = "SELECT o_custkey, count(DISTINCT o_orderpriority) AS parts FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) > 1"
ORACLE["repeated_ids"] = "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1"
ORACLE["wanted_states"] = """WITH w AS (SELECT DISTINCT doc_id FROM labels WHERE doc_id IS NOT NULL) SELECT 'label' || label AS field, count(*) AS states FROM embeddings JOIN w ON doc_id = vec_id GROUP BY label UNION ALL SELECT 'missing', count(*) FROM w WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)"""
ORACLE["offset_audit"] = """WITH b AS (SELECT o_custkey, o_orderkey, o_orderkey % 5 + 1 AS size, coalesce(sum(o_orderkey % 5 + 1) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + CASE WHEN o_orderkey % 101 = 0 THEN 1 ELSE 0 END AS off FROM orders),
    e AS (SELECT *, coalesce(lag(off + size) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 0) AS expected FROM b) SELECT o_custkey, o_orderkey, CAST(off AS BIGINT) AS "offset", CAST(expected AS BIGINT) AS expected FROM e WHERE off <> expected"""
ORACLE["precision_audit"] = "SELECT d AS decimals, CAST(sum(k) AS BIGINT) AS records FROM (SELECT 1 AS d, 13 * count(*) AS k FROM embeddings WHERE vec_id % 4 = 0 UNION ALL SELECT 3, count(*) FROM embeddings WHERE vec_id % 4 = 0) GROUP BY d"
ORACLE["source_preflight"] = "SELECT 'emb' AS source_id, count(DISTINCT vec_id) AS trajectories, CAST(1 AS BIGINT) AS shapes, count(DISTINCT vec_id) >= 20 AS sound FROM embeddings UNION ALL SELECT 'evt', count(DISTINCT event_type), 1, count(DISTINCT event_type) >= 20 FROM events UNION ALL SELECT 'lin', count(DISTINCT l_suppkey), 1, count(DISTINCT l_suppkey) >= 20 FROM lineitem"
ORACLE["content_digests"] = f"""WITH {RAW}, rows_ AS (SELECT state_ref, field, r, sha256(string_agg(CAST(CAST(floor(x * 1073741824) AS HUGEINT) AS VARCHAR), ',' ORDER BY c)) AS d FROM raw GROUP BY ALL)
    SELECT state_ref, field, sha256(string_agg(d, ',' ORDER BY r)) AS digest FROM rows_ GROUP BY ALL"""
ORACLE["trajectory_split"] = "WITH r AS (SELECT c_custkey AS trajectory, row_number() OVER (ORDER BY sha256('1:' || c_custkey)) - 1 AS i, count(*) OVER () AS n FROM customer) SELECT trajectory, CASE WHEN i < n * 8 // 10 THEN 'train' WHEN i < n * 9 // 10 THEN 'val' ELSE 'test' END AS split FROM r"
_POOLS = "s AS (SELECT h, w, h IN (1, 32) AND w IN (1, 24) AS anchor FROM (SELECT unnest(range(1, 33)) AS h), (SELECT unnest(range(1, 25)) AS w)), pools AS (SELECT CAST(h AS INTEGER) AS h, CAST(w AS INTEGER) AS w, anchor, CASE WHEN NOT anchor AND row_number() OVER (PARTITION BY anchor ORDER BY sha256('1:' || h || ':' || w)) <= 153 THEN 'heldout' ELSE 'train' END AS pool FROM s)"
ORACLE["shape_pools"] = """WITH size AS (SELECT (SELECT max(p_size) FROM part) AS high, (SELECT count(*) FROM nation) AS wide), s AS (SELECT h, w, high, wide, h IN (1, high) AND w IN (1, wide) AS anchor FROM size CROSS JOIN (SELECT unnest(range(1, high + 1)) AS h FROM size) CROSS JOIN (SELECT unnest(range(1, wide + 1)) AS w FROM size)),
    pools AS (SELECT CAST(h AS INTEGER) AS h, CAST(w AS INTEGER) AS w, anchor, CASE WHEN NOT anchor AND row_number() OVER (PARTITION BY anchor ORDER BY sha256('1:' || h || ':' || w)) <= floor(high * wide * 0.2::DOUBLE) THEN 'heldout' ELSE 'train' END AS pool FROM s),
    p AS (SELECT CAST(p_size AS INTEGER) AS h, CAST(p_partkey % (SELECT wide FROM size) + 1 AS INTEGER) AS w, count(*) AS parts FROM part GROUP BY ALL) SELECT h, w, anchor, pool, coalesce(parts, 0) AS parts FROM pools LEFT JOIN p USING (h, w)"""
ORACLE["evaluation_plan"] = """WITH f AS (SELECT r_name AS field, row_number() OVER (ORDER BY r_regionkey) - 1 AS i FROM region), k AS (SELECT unnest(range(0, 180)) AS k), p AS (SELECT CASE WHEN k % 2 = 0 THEN 'heldout' ELSE 'train' END AS part, field FROM k JOIN f ON k % 5 = i UNION ALL SELECT 'boundary', field FROM f, (SELECT unnest(range(0, 4))))
    SELECT part, field, count(*) AS rows FROM p GROUP BY ALL"""
ORACLE["fitting_tasks"] = """WITH s AS (SELECT CAST(p_size % 4 + 1 AS INTEGER) AS h, CAST((p_size // 4) % 4 + 1 AS INTEGER) AS w FROM part), t AS (SELECT unnest(['single_point', 'region_values', 'region_min', 'region_max', 'region_argmin', 'region_argmax', 'nearest_value_location', 'threshold_fraction']) AS task, 1 AS least_ UNION ALL SELECT unnest(['multi_point', 'point_difference', 'region_mean', 'region_std', 'region_mean_difference', 'line_profile']), 2)
    SELECT h, w, task, count(*) AS parts FROM s, t WHERE h * w >= least_ GROUP BY ALL"""
ORACLE["balanced_quotas"] = """WITH f AS (SELECT r_name, 1000 // count(*) OVER () + CASE WHEN row_number() OVER (ORDER BY r_name) - 1 < 1000 % count(*) OVER () THEN 1 ELSE 0 END AS share FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)),
    m AS (SELECT r_name, n_name, share, row_number() OVER (PARTITION BY r_name ORDER BY n_name) - 1 AS j, count(*) OVER (PARTITION BY r_name) AS k FROM nation JOIN region ON n_regionkey = r_regionkey JOIN f USING (r_name)) SELECT r_name, n_name, CAST(share // k + CASE WHEN j < share % k THEN 1 ELSE 0 END AS BIGINT) AS quota FROM m"""
ORACLE["trajectory_cycles"] = """WITH m AS (SELECT s_nationkey, s_suppkey, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier), y AS (SELECT m.*, unnest(range(0, 39 // n + 1)) AS cycle FROM m), r AS (SELECT *, cycle * n + row_number() OVER (PARTITION BY s_nationkey, cycle ORDER BY sha256('1:' || cycle || ':' || s_suppkey)) - 1 AS i FROM y)
    SELECT s_nationkey, CAST(i AS INTEGER) AS i, s_suppkey, CAST(cycle AS INTEGER) AS cycle FROM r WHERE i < 40"""


def draw(n: str, key: str) -> str:
    """A number in [0, n) from the SHA-256 of a key."""
    return f"(CAST('0x' || sha256({key})[:12] AS BIGINT) % {n})"


ORACLE["time_cycles"] = f"""SELECT s_suppkey AS key, CAST(visit AS INTEGER) AS visit, CAST(({draw("12", "'1:offset:' || s_suppkey")} + visit * [1, 5, 7, 11][{draw("4", "'1:stride:' || s_suppkey")} + 1]) % 12 AS INTEGER) AS time FROM supplier, (SELECT unnest(range(0, 12)) AS visit)"""
ORACLE["weighted_tasks"] = f"""WITH u AS (SELECT p_brand, p_partkey, -ln(({draw("1000003", "'1:' || p_brand || ':' || p_partkey")} + 0.5) / 1000003.0::DOUBLE) / (p_size + 1) AS race FROM part), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY race, p_partkey) AS INTEGER) AS rank FROM u) SELECT p_brand, p_partkey, rank FROM r WHERE rank <= 3"""
ORACLE["crop_quota"] = "WITH u AS (SELECT DISTINCT 'label' || label AS field, CAST(vec_id % 40 AS VARCHAR) AS crop FROM embeddings), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY field ORDER BY sha256('1:' || crop)) AS INTEGER) AS i FROM u) SELECT field, crop, i FROM r WHERE i <= 2"
ORACLE["balanced_parts"] = "SELECT s_suppkey, CAST(ntile(7) OVER (ORDER BY s_suppkey) - 1 AS INTEGER) AS part FROM supplier"
_SPLIT = "CASE WHEN n % 10 < 8 THEN 'train' WHEN n % 10 = 8 THEN 'val' ELSE 'test' END"
_COUNTED = {"family": "CASE WHEN n % 2 = 0 THEN 'even' ELSE 'odd' END", "source_id": "'emb'", "field": "field", "shape": "'8x8'", "task": "task", "capability": "capability", "difficulty": "difficulty"}
ORACLE["build_counters"] = f"WITH {PROGRAMS}, {GEOMETRY} " + " UNION ALL ".join(f"SELECT {_SPLIT} AS split, '{k}' AS dim, {v} AS key, count(*) AS records, count(DISTINCT state_ref) AS states FROM sized GROUP BY ALL" for k, v in _COUNTED.items())
ORACLE["coverage_counts"] = f"SELECT {_SPLIT} AS split, 'emb' AS source_id, count(DISTINCT n % 6) AS source_files, count(DISTINCT (n % 6, n % 50)) AS trajectories, count(DISTINCT (n % 6, field, n % 50)) AS field_trajectories, count(DISTINCT (n % 6, field, n % 50, n % 7)) AS field_frames, count(DISTINCT (n % 3, n % 5)) AS top_left_coordinates, CAST(1 AS BIGINT) AS shapes, count(*) AS sampled_crops FROM (SELECT vec_id AS n, label AS field FROM embeddings) GROUP BY ALL"
ORACLE["template_partitions"] = "WITH t AS (SELECT * FROM (VALUES ('train', 'direct'), ('train', 'question'), ('train', 'region_first'), ('train', 'coordinate_tuple'), ('val', 'interval'), ('test', 'relative')) AS v(split, template)), x AS (SELECT template FROM t GROUP BY template HAVING count(DISTINCT split) > 1) SELECT split, count(*) AS templates, count(*) FILTER (template IN (SELECT template FROM x)) AS shared, CAST(count(*) * 14 * (SELECT count(*) FROM embeddings) AS BIGINT) AS records FROM t GROUP BY split"
ORACLE["prompt_lengths"] = f"WITH q AS ({ORACLE['full_matrix_prompt']}) SELECT CAST(min(length(prompt)) AS INTEGER) AS least, CAST(max(length(prompt)) AS INTEGER) AS most, avg(length(prompt)) AS mean FROM q"
_REQ = "q AS (SELECT o_orderkey AS id, CAST(o_orderkey % 4 + 1 AS INTEGER) AS h, CAST(o_custkey % 3 + 1 AS INTEGER) AS w, CAST(floor(o_totalprice % 997 + 1) AS INTEGER) AS tokens FROM orders)"
ORACLE["shape_batches"] = f"""WITH {_REQ}, n AS (SELECT count(*) AS n FROM q GROUP BY h, w), b AS (SELECT unnest(list_concat(list_transform(range(0, n // 32), lambda x: 32), CASE WHEN n % 32 > 0 THEN [n % 32] ELSE [] END)) AS k FROM n)
    SELECT count(*) AS batches, CAST(sum(k) AS BIGINT) AS total, CAST(min(k) AS BIGINT) AS least, CAST(max(k) AS BIGINT) AS most, round(avg(k), 9) AS mean, count(*) FILTER (k < 32) AS partial FROM b"""
ORACLE["planned_updates"] = f"WITH {_REQ}, n AS (SELECT ceil(count(*) / 32) AS b FROM q GROUP BY h, w) SELECT CAST(ceil(sum(b) * 3 / 4) AS BIGINT) AS updates FROM n"
ORACLE["padding_share"] = f"WITH {_REQ}, n AS (SELECT sum(tokens) AS t, count(*) * max(tokens) AS p FROM q GROUP BY h, w) SELECT round(1 - sum(t) / sum(p), 9) AS padding_fraction FROM n"
ORACLE["token_preflight"] = f"WITH {_REQ} SELECT count(*) AS rows, max(tokens) AS longest, (SELECT id FROM q ORDER BY tokens DESC, id LIMIT 1) AS longest_id, count(*) FILTER (tokens > 900) AS over FROM q"
ORACLE["token_examples"] = f"WITH {_REQ} SELECT id, tokens FROM q WHERE tokens > 900 ORDER BY id LIMIT 8"
ORACLE["strided_merge"] = f"WITH {_REQ} SELECT id AS i, CAST(tokens AS BIGINT) AS length FROM q"
ORACLE["running_offsets"] = f'WITH {_REQ} SELECT id, CAST(coalesce(sum(tokens) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM q'
ORACLE["field_runs"] = "SELECT o_custkey, CAST(1 + count(*) FILTER (p <> o_orderpriority) AS BIGINT) AS runs FROM (SELECT o_custkey, o_orderpriority, lag(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM orders) GROUP BY o_custkey"
ORACLE["length_balance"] = "SELECT CAST(o_orderkey // 48 AS INTEGER) AS batch, count(*) AS rows, least(3, count(*)) AS parts FROM orders GROUP BY 1"
ORACLE["geometry_extrema"] = f"WITH {_REQ} SELECT 'cells' AS criterion, (SELECT id FROM q ORDER BY h * w DESC, id LIMIT 1) AS id UNION ALL SELECT 'height', (SELECT id FROM q ORDER BY h DESC, id LIMIT 1) UNION ALL SELECT 'width', (SELECT id FROM q ORDER BY w DESC, id LIMIT 1) UNION ALL SELECT 'aspect', (SELECT id FROM q ORDER BY greatest(h, w) / least(h, w) DESC, id LIMIT 1)"
_BLOCKS = f"{CELLS}, slots AS (SELECT DISTINCT state_ref, CAST(t AS INTEGER) AS token, CAST(s AS INTEGER) AS slot, t // 3 * 3 + s // 3 + 1 AS r, t % 3 * 3 + s % 3 + 1 AS c FROM cells, (SELECT unnest(range(0, 9)) AS t), (SELECT unnest(range(0, 9)) AS s)), tokens AS (SELECT s.state_ref, token, slot, coalesce(z, 0.0) AS z, CAST(z IS NOT NULL AS INTEGER) AS mask FROM slots s LEFT JOIN cells g ON s.state_ref = g.state_ref AND s.r = g.r AND s.c = g.c)"
ORACLE["block_tokens"] = f"WITH {_BLOCKS} SELECT * FROM tokens"
ORACLE["masked_loss"] = f"WITH {_BLOCKS}, d AS (SELECT abs(z - 0.25) AS d, mask FROM tokens) SELECT round(sum(CASE WHEN d < 1 THEN 0.5 * d * d ELSE d - 0.5 END * mask) / greatest(sum(mask), 1), 9) AS loss FROM d"
ORACLE["channel_scaling"] = "WITH k AS (SELECT l_returnflag AS ch, min(l_quantity) AS a, max(l_quantity) - min(l_quantity) + 1e-6 AS b FROM lineitem GROUP BY 1), y AS (SELECT ch, a, greatest(-0.9, least(0.9, (l_quantity - a) / b)) AS y FROM lineitem JOIN k ON ch = l_returnflag) SELECT ch, count(*) AS n, round(sum(round(y * 1000)), 0) AS total, min(a) AS a, round(max(y), 9) AS most FROM y GROUP BY ch"
ORACLE["value_basis"] = f"WITH {CELLS} SELECT state_ref, r, c, round(z, 9) + 0.0 AS z, round(tanh(z), 9) + 0.0 AS tanh, round(abs(z), 9) + 0.0 AS abs, CAST(sign(z) AS DOUBLE) + 0.0 AS sign, round(sin(z * pi()), 9) + 0.0 AS sin0, round(cos(z * pi()), 9) + 0.0 AS cos0, round(sin(z * 2 * pi()), 9) + 0.0 AS sin1, round(cos(z * 2 * pi()), 9) + 0.0 AS cos1 FROM cells"
ORACLE["positions"] = "SELECT n_nationkey AS p, round(sin(n_nationkey), 9) + 0.0 AS sin0, round(cos(n_nationkey), 9) + 0.0 AS cos0, round(sin(n_nationkey / 100.0), 9) + 0.0 AS sin1, round(cos(n_nationkey / 100.0), 9) + 0.0 AS cos1 FROM nation"
ORACLE["schedule"] = "SELECT n_nationkey AS step, round(CASE WHEN n_nationkey < 5 THEN (n_nationkey + 1) / 5.0 ELSE 0.1 + 0.9 * 0.5 * (1 + cos((n_nationkey - 5) / 20.0 * pi())) END, 9) AS factor FROM nation"
ORACLE["integer_functions"] = "SELECT p_partkey, CAST(gcd(p_partkey * 7, 3360) AS BIGINT) AS gcd, CAST(ceil(p_size / 7) AS INTEGER) AS pieces, CAST(length(bin(p_size)) AS INTEGER) AS bits, CAST(pow(2, floor(log2(p_size))) AS BIGINT) AS power FROM part"
ORACLE["exact_rounding"] = f"WITH d AS (SELECT DISTINCT l_partkey % 2000 AS k, l_suppkey % 97 + 1 AS n FROM lineitem) SELECT k, n, {exact('k / n', 1)} AS r1, {exact('k / n', 2)} AS r2, {exact('k / n', 3)} AS r3 FROM d"
ORACLE["half_precision"] = f"WITH d AS (SELECT DISTINCT l_extendedprice / 1000 / l_quantity AS v FROM lineitem) SELECT v, {fp16('v')} AS half FROM d"
ORACLE["count_buckets"] = f"SELECT p_partkey, {_case_counts('p_size * p_size', COUNT_ENDS)} AS bucket, {_case_counts('p_size * p_size', COUNT_ENDS[:6])} AS difficulty FROM part"
ORACLE["shape_parser"] = "WITH k AS (SELECT p_partkey, p_partkey % 3 < 2 AS good, p_size AS h, p_size % 9 AS w FROM part) SELECT p_partkey, CASE WHEN good THEN h END AS h, CASE WHEN good THEN w END AS w, good AND h >= 4 AND w >= 4 AS ok FROM k"
ORACLE["path_safety"] = "SELECT p_partkey, p_partkey % 8 IN (0, 7) AS safe FROM part"
_TIMES = """t AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'serialized' ELSE 'interface' END AS method, CASE WHEN event_id // 2 % 2 = 0 THEN 'natural' ELSE 'fixed' END AS decode_mode, 'cells_' || event_id // 4 % 3 AS bin, 'q' || event_id // 2 AS qa_id, ['complete', 'fixed_length', 'length_limit', 'complete', 'oom'][event_id // 7 % 5 + 1] AS status,
    CAST((event_id % 89) / 4.0 + 1 AS DOUBLE) AS ms, CASE WHEN event_id % 5 <> 0 THEN CAST((event_id % 17) / 8.0 AS DOUBLE) END AS ttft, event_id % 33 AS tok, CAST((event_id % 41) / 16.0 AS DOUBLE) AS peak FROM events)"""
ORACLE["efficiency_summary"] = f"""WITH {_TIMES}, u AS (SELECT *, status IN ('complete', 'fixed_length') AS done, status IN ('complete', 'fixed_length', 'length_limit') AS ran FROM t)
    SELECT method, decode_mode, bin, count(*) AS attempts, count(DISTINCT qa_id) AS unique_questions, count(*) FILTER (done) AS completed, count(*) FILTER (status = 'length_limit') AS length_limited, count(*) FILTER (status = 'oom') AS out_of_memory, round(count(*) FILTER (done) / (sum(ms) / 1000), 7) AS completed_per_second, round(sum(tok) / (sum(ms) / 1000), 7) AS tokens_per_second,
    round(quantile_cont(ms, 0.5) FILTER (done), 7) AS completed_p50_ms, round(quantile_cont(ms, 0.95) FILTER (done), 7) AS completed_p95_ms, round(avg(ms) FILTER (ran), 7) AS request_ms_mean, round(quantile_cont(ttft, 0.5) FILTER (ran), 7) AS ttft_ms_p50, round(avg(ttft) FILTER (ran), 7) AS ttft_ms_mean, round(avg(tok) FILTER (ran), 7) AS generated_tokens_mean, round(max(peak) FILTER (ran), 7) AS peak_gib, round(max(peak) FILTER (status = 'oom'), 7) AS oom_peak_gib FROM u GROUP BY method, decode_mode, bin"""
ORACLE["paired_speed"] = f"WITH {_TIMES}, g AS (SELECT * FROM t WHERE status IN ('complete', 'fixed_length')) SELECT a.decode_mode, a.bin, count(*) AS pairs, round(sum(a.ms) / sum(b.ms), 9) AS time_ratio, round(avg(a.tok), 9) AS slow_tokens_mean, round(avg(b.tok), 9) AS fast_tokens_mean FROM g a JOIN g b ON a.method = 'serialized' AND b.method = 'interface' AND a.decode_mode = b.decode_mode AND a.bin = b.bin AND a.qa_id = b.qa_id GROUP BY ALL"
ORACLE["distinct_points"] = f"""WITH RECURSIVE walk AS (SELECT s_suppkey, i, 0 AS t, i // 8 AS l, i % 8 AS r FROM supplier, (SELECT unnest(range(0, 6)) AS i)
    UNION ALL SELECT s_suppkey, i, t + 1, r, (l + {draw('8', "'1:' || s_suppkey || ':points:round:' || (t % 8) || ':' || r")}) % 8 FROM walk WHERE NOT (t > 0 AND t % 8 = 0 AND l * 8 + r < 49))
    SELECT s_suppkey, CAST(i AS INTEGER) AS i, CAST(l * 8 + r AS BIGINT) AS cell FROM walk WHERE t > 0 AND t % 8 = 0 AND l * 8 + r < 49"""
_KIND = "CASE WHEN {0} < 4 THEN 4.0 WHEN {0} < 8 THEN 2.0 WHEN {0} < 11 THEN 3.0 ELSE 1.0 END::DOUBLE"
_SHARE = _KIND.format("x") + " / len(list_filter(rest, lambda y: " + _KIND.format("y") + " = " + _KIND.format("x") + "))"
_NAMES = "['single_point','multi_point','line_profile','region_values','region_mean','region_std','region_min','region_max','region_argmin','region_argmax','nearest_value_location','point_difference','region_mean_difference','threshold_fraction']"
ORACLE["sequential_tasks"] = f"""WITH RECURSIVE {STATES}, fold AS (SELECT state_ref, 0 AS i, range(0, 14) AS rest, CAST(NULL AS BIGINT) AS task FROM states
    UNION ALL SELECT state_ref, i + 1, list_filter(rest, lambda x: x <> rest[pos]), rest[pos] FROM (
        SELECT state_ref, i, rest, least(len(list_filter(range(1, len(rest) + 1), lambda j: list_sum(shares[1:j]) <= u * list_sum(shares))) + 1, len(rest)) AS pos
        FROM (SELECT state_ref, i, rest, list_transform(rest, lambda x: {_SHARE}) AS shares, CAST('0x' || sha256('1:' || state_ref || ':pick:' || (i + 1))[:12] AS BIGINT) / 281474976710656.0::DOUBLE AS u FROM fold WHERE i < 4)))
    SELECT state_ref, i AS rank, {_NAMES}[task + 1] AS task FROM fold WHERE i > 0"""
ORACLE["budget_shortfall"] = """WITH p AS (SELECT p_brand AS split, p_size % 3 + 1 AS h, (p_size // 3) % 3 + 1 AS w FROM part),
    n AS (SELECT split, 8 + CASE WHEN h * w >= 2 THEN 5 ELSE 0 END + CASE WHEN greatest(h, w) >= 2 THEN 1 ELSE 0 END AS n FROM p)
    SELECT split, count(*) AS groups, count(*) * 14 AS wanted, CAST(sum(n) AS BIGINT) AS selected, CAST(sum(14 - n) AS BIGINT) AS missing FROM n GROUP BY split"""
ORACLE["token_budgets"] = """WITH q AS (SELECT o_orderkey AS position, 'o' || o_orderkey AS qa_id, o_orderstatus AS template_family, CAST(floor(o_totalprice) AS BIGINT) % 400 AS p, o_custkey % 45 AS t FROM orders)
    SELECT template_family, count(*) AS questions, CAST(max(p) AS BIGINT) AS max_prompt_tokens, arg_max(qa_id, p * 1000000000 - position) AS max_prompt_qa_id, CAST(max(t) AS BIGINT) AS max_target_tokens, arg_max(qa_id, t * 1000000000 - position) AS max_target_qa_id,
    count(*) FILTER (p > 380) AS prompt_overflow, count(*) FILTER (t > 42) AS target_overflow, count(*) FILTER (p > 380 OR t > 42) AS overflow, coalesce(array_to_string((list(qa_id ORDER BY position) FILTER (p > 380 OR t > 42))[1:8], ','), '') AS examples, CASE WHEN count(*) FILTER (p > 380 OR t > 42) > 0 THEN 'overflow' ELSE 'ok' END AS status FROM q GROUP BY template_family"""
ORACLE["balanced_shards"] = "SELECT count(*) AS rows, count(DISTINCT CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_custkey END) AS states, CAST(0 AS BIGINT) AS split_states, CAST(6 AS BIGINT) AS shards, true AS within FROM orders"
_OLD = lambda n, what: draw(n, f"'{what}:1:' || state_ref || ':' || task")
ORACLE["legacy_programs"] = f"""WITH {STATES}, t AS (SELECT state_ref, unnest({_NAMES}[1:11]) AS task FROM states),
    o AS (SELECT *, CASE WHEN task IN ('single_point', 'multi_point') THEN NULL WHEN task = 'line_profile' THEN [[3, 0], [3, 1], [4, 0], [4, 1], [5, 0], [5, 1]][{_OLD('6', 'choice')} + 1] WHEN task = 'region_values' THEN [2, 2] ELSE [[2, 2], [4, 4]][{_OLD('2', 'choice')} + 1] END AS x FROM t),
    e AS (SELECT *, CASE WHEN x IS NULL THEN 1 WHEN task = 'line_profile' THEN 1 + (x[1] - 1) * x[2] ELSE x[1] END AS high, CASE WHEN x IS NULL THEN 1 WHEN task = 'line_profile' THEN 1 + (x[1] - 1) * (1 - x[2]) ELSE x[2] END AS wide FROM o),
    p AS (SELECT *, 1 + {_OLD('(8 - high + 1)', 'row')} AS r, 1 + {_OLD('(8 - wide + 1)', 'column')} AS c FROM e)
    SELECT state_ref, task, CAST(CASE WHEN task <> 'multi_point' THEN r END AS INTEGER) AS r1, CAST(CASE WHEN task <> 'multi_point' THEN c END AS INTEGER) AS c1, CAST(CASE WHEN task <> 'multi_point' THEN r + high - 1 END AS INTEGER) AS r2, CAST(CASE WHEN task <> 'multi_point' THEN c + wide - 1 END AS INTEGER) AS c2,
    CAST(CASE WHEN task = 'multi_point' THEN 2 + {_OLD('3', 'count')} ELSE high * wide END AS BIGINT) AS cells, CAST(CASE WHEN task = 'nearest_value_location' THEN r + {_OLD('high', 'tr')} END AS INTEGER) AS tr, CAST(CASE WHEN task = 'nearest_value_location' THEN c + {_OLD('wide', 'tc')} END AS INTEGER) AS tc FROM p"""
ORACLE["state_shards"] = f"SELECT 'emb:' || vec_id AS state_ref, CAST({draw('8', "'shard:emb:' || vec_id")} AS INTEGER) AS shard, CAST(1 AS BIGINT) AS shards, CAST(14 AS BIGINT) AS rows FROM embeddings"
ORACLE["benchmark_requests"] = """WITH q AS (SELECT 'q' || vec_id AS qa_id, 'label' || label AS task, CAST((CAST(vec_id AS INTEGER) * 37) % 300 + 1 AS INTEGER) AS cells FROM embeddings),
    b AS (SELECT *, CASE WHEN cells <= 64 THEN 'cells_1_64' ELSE 'cells_65_256' END AS bin, sha256('1:' || qa_id) AS h FROM q WHERE cells <= 256), t AS (SELECT *, row_number() OVER (PARTITION BY bin, task ORDER BY h) AS turn FROM b),
    r AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY turn, sha256('1:' || bin || ':' || task)) AS rank, max(cells) OVER (PARTITION BY bin) AS largest FROM t),
    top AS (SELECT bin, max(cells) AS had, max(rank) AS last FROM r WHERE rank <= 12 GROUP BY bin),
    stand AS (SELECT r.bin, qa_id, task, cells, last AS rank FROM r JOIN top ON top.bin = r.bin AND had < largest AND cells = largest QUALIFY row_number() OVER (PARTITION BY r.bin ORDER BY h) = 1)
    SELECT bin, qa_id, task, cells, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 12 AND (bin, rank) NOT IN (SELECT (bin, rank) FROM stand) UNION ALL SELECT bin, qa_id, task, cells, CAST(rank AS INTEGER) FROM stand"""
ORACLE["legacy_records"] = f"""WITH {RECORDS} SELECT state_ref, task, answer, CASE WHEN place THEN array_to_string(flatten(list_transform(runs, lambda q: list_transform(range(q.c0, q.c1 + 1), lambda c: q.r || ',' || c))), ';') END AS ties FROM records
    WHERE task NOT IN ('point_difference', 'region_mean_difference', 'threshold_fraction', 'line_profile')"""
