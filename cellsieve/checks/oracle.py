"""The same queries in plain SQL over the given tables, run by DuckDB to check the Spark results."""

from __future__ import annotations

from cellsieve.checks.registry import K, NPROBE, PQ_BITS, PQ_M

ORACLES: dict[str, str] = {}

SPACES = "[ \\t\\n\\r\\f]+"
DIM = 64
SEED = 6400
CODES = 2**PQ_BITS
WIDTH = DIM // PQ_M

# ------------------------------------------------------------------------------------------------ shared pieces

DOCS = f"""
docs AS (
  SELECT d.doc_id AS item_id, d.doc_id AS ext_id, d.source || ' ' || d.lang || ' ' || d.doc_id AS title, p.url,
         date_trunc('second', v.ts) AS revdate,
         len(string_split_regex(trim(d.text), '{SPACES}'))::INT AS token_count, d.source AS entity, d.text
  FROM documents d JOIN events v ON v.event_id = d.doc_id LEFT JOIN pages p ON p.page_id = d.doc_id
)"""


def unit(vector: str) -> str:
    """Unit length in 32-bit floats, as doubles."""
    v = f"({vector})::DOUBLE[]"
    return f"list_transform({v}, lambda x: (x / (sqrt(list_dot_product({v}, {v})) + 1e-12))::FLOAT)::DOUBLE[]"


ITEMS = f"""{DOCS},
items AS (
  SELECT docs.* EXCLUDE (text), {unit('e.embedding')} AS embedding FROM docs JOIN embeddings e ON e.vec_id = docs.item_id
)"""
BIG = """
big AS (
  SELECT o_orderkey AS item_id, floor(o_totalprice)::INT AS token_count, o_orderdate AS revdate FROM orders
)"""
ITEM_COLUMNS = "item_id, ext_id, title, url, revdate, token_count, entity"


def prototypes(key: str = "label") -> str:
    return f"""
coords AS (
  SELECT qid, pos, avg(x) AS x FROM (
    SELECT {key}::BIGINT AS qid, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings
  ) GROUP BY qid, pos
),
queries AS (
  SELECT qid, {unit('m')} AS qvec
  FROM (SELECT qid, list(x ORDER BY pos) AS m FROM coords GROUP BY qid)
)"""


def similarity(a: str, b: str) -> str:
    return f"round(list_dot_product({a}, {b}), 9)"


def seeds(count: str, source: str = "items") -> str:
    return f"""
seeds AS (
  SELECT item_id AS cell_id, embedding AS centroid FROM {source}
  QUALIFY row_number() OVER (ORDER BY md5('{SEED}:' || item_id), item_id) <= ({count})
),
nlist AS (SELECT count(*) AS n FROM seeds),
placed AS (
  SELECT i.item_id, s.cell_id, s.centroid FROM {source} i, seeds s
  QUALIFY row_number() OVER (PARTITION BY i.item_id ORDER BY {similarity('i.embedding', 's.centroid')} DESC, s.cell_id) = 1
)"""


def coarse(source: str = "items") -> str:
    return seeds(f"SELECT floor(sqrt(count(*))) FROM {source}", source)


def fine(source: str = "items") -> str:
    return seeds(f"SELECT count(*) // 4 FROM {source}", source)


CELL_RANKS = f"""
cell_ranks AS (
  SELECT q.qid, s.cell_id, {similarity('q.qvec', 's.centroid')} AS cell_sim,
         row_number() OVER (PARTITION BY q.qid ORDER BY {similarity('q.qvec', 's.centroid')} DESC, s.cell_id) AS cell_rank
  FROM queries q, seeds s
)"""


def scored(source: str = "items") -> str:
    """Every (query, item) with the rank of the item's cell for that query."""
    return f"""{CELL_RANKS},
scored AS (
  SELECT q.qid, i.item_id, r.cell_rank, i.token_count, i.revdate, {similarity('q.qvec', 'i.embedding')} AS similarity
  FROM queries q, {source} i JOIN placed p USING (item_id) JOIN cell_ranks r ON r.qid = q.qid AND r.cell_id = p.cell_id
)"""


def top(source: str, k: int, where: str = "true") -> str:
    return f"""
  SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, item_id) AS rank, item_id, similarity
  FROM {source} WHERE {where} QUALIFY rank <= {k}"""


RANKED = "qid, rank, item_id, similarity"


def axis_edges(source: str) -> str:
    """Exact linear percentiles by rank arithmetic, ten bins per axis."""
    return f"""
axes AS (
  SELECT item_id, token_count::DOUBLE AS number, epoch(revdate)::DOUBLE AS date FROM {source}
  WHERE token_count IS NOT NULL AND revdate IS NOT NULL
),
stacked AS (SELECT 'number' AS axis, number AS v FROM axes UNION ALL SELECT 'date', date FROM axes),
numbered AS (
  SELECT axis, v, row_number() OVER (PARTITION BY axis ORDER BY v) - 1 AS r, count(*) OVER (PARTITION BY axis) AS n FROM stacked
),
marks AS (
  SELECT DISTINCT axis, i, (n - 1) * i // 10 AS r, ((n - 1) * i % 10)::DOUBLE / 10::DOUBLE AS part, n FROM numbered, range(11) t(i)
),
edges AS (
  SELECT m.axis, m.i::INT AS edge_index, a.v + (coalesce(b.v, a.v) - a.v) * m.part AS value
  FROM marks m JOIN numbered a ON a.axis = m.axis AND a.r = m.r LEFT JOIN numbered b ON b.axis = m.axis AND b.r = m.r + 1
),
lists AS (
  SELECT list(value ORDER BY edge_index) FILTER (axis = 'number') AS numbers, list(value ORDER BY edge_index) FILTER (axis = 'date') AS dates FROM edges
),
cells AS (
  SELECT greatest(0, least(9, len(list_filter(numbers, lambda x: x < number)) - 1))::INT AS i,
         greatest(0, least(9, len(list_filter(dates, lambda x: x < date)) - 1))::INT AS j, count(*) AS n
  FROM axes, lists GROUP BY ALL
),
grid AS (
  SELECT a.i::INT AS i, b.j::INT AS j, coalesce(n, 0) AS n FROM range(10) a(i), range(10) b(j) LEFT JOIN cells c ON c.i = a.i AND c.j = b.j
),
bins AS (
  SELECT a.axis, a.edge_index AS b, a.value AS lo, z.value AS hi FROM edges a JOIN edges z ON z.axis = a.axis AND z.edge_index = a.edge_index + 1
)"""


# Predicate lists (wid, axis, op, v): v is a number, dates in epoch seconds; IN has one row per value.
WORKLOAD = """
floors AS (SELECT axis, edge_index AS i, floor(value) AS v FROM edges),
workload AS (
  SELECT 'single' AS kind, i AS wid, 1 AS seq, axis, '>=' AS op, v FROM floors WHERE axis = 'number' AND i BETWEEN 1 AND 9
  UNION ALL SELECT 'single', 10 + i, 1, axis, '>=', v FROM floors WHERE axis = 'date' AND i BETWEEN 1 AND 9
  UNION ALL SELECT 'dual', 20 + i, 1, axis, '>=', v FROM floors WHERE axis = 'number' AND i BETWEEN 1 AND 9
  UNION ALL SELECT 'dual', 20 + i, 2, axis, '>=', v FROM floors WHERE axis = 'date' AND i BETWEEN 1 AND 9
  UNION ALL SELECT 'selective', 31, 1, axis, '>=', v FROM floors WHERE axis = 'number' AND i = 9
  UNION ALL SELECT 'selective', 31, 2, axis, '>=', v FROM floors WHERE axis = 'date' AND i = 9
  UNION ALL SELECT 'selective', 31, 3, axis, '<', v FROM floors WHERE axis = 'number' AND i = 10
  UNION ALL SELECT 'selective', 32, 1, axis, '<=', v FROM floors WHERE axis = 'number' AND i = 1
  UNION ALL SELECT 'selective', 32, 2, axis, '<', v FROM floors WHERE axis = 'date' AND i = 1
  UNION ALL SELECT 'selective', 33, 1, axis, '=', v FROM floors WHERE axis = 'number' AND i = 5
  UNION ALL SELECT 'selective', 33, 2, axis, '>', v FROM floors WHERE axis = 'date' AND i = 1
  UNION ALL SELECT 'selective', 34, 1, axis, 'IN', v FROM floors WHERE axis = 'number' AND i IN (1, 4, 7)
  UNION ALL SELECT 'selective', 34, 2, axis, '=', v FROM floors WHERE axis = 'date' AND i = 5
  UNION ALL SELECT 'selective', 35, 1, axis, '>', v FROM floors WHERE axis = 'number' AND i = 2
  UNION ALL SELECT 'selective', 35, 2, axis, '<=', v FROM floors WHERE axis = 'number' AND i = 3
)"""

FRACTION = """CASE op
    WHEN '>' THEN CASE WHEN lo > v THEN 1.0::DOUBLE WHEN lo <= v AND v < hi THEN (hi - v) / (hi - lo) ELSE 0 END
    WHEN '>=' THEN CASE WHEN lo >= v THEN 1.0::DOUBLE WHEN lo < v AND v <= hi THEN (hi - v) / (hi - lo) ELSE 0 END
    WHEN '<' THEN CASE WHEN hi < v THEN 1.0::DOUBLE WHEN lo < v AND v <= hi THEN (v - lo) / (hi - lo) ELSE 0 END
    WHEN '<=' THEN CASE WHEN hi <= v THEN 1.0::DOUBLE WHEN lo <= v AND v < hi THEN (v - lo) / (hi - lo) ELSE 0 END
    ELSE CASE WHEN lo <= v AND v <= hi THEN 1.0::DOUBLE ELSE 0 END END"""


def estimates(workload: str = "workload") -> str:
    """Bin weights are products over the predicates of an axis, the best value first for IN."""
    return f"""
weights AS (
  SELECT wid, axis, b, product(w) AS w FROM (
    SELECT wid, seq, bins.axis, b, max({FRACTION}) AS w FROM {workload} wl JOIN bins ON bins.axis = wl.axis GROUP BY wid, seq, bins.axis, b
  ) GROUP BY wid, axis, b
),
estimates AS (
  SELECT wl.wid, floor(round(sum(c.n * coalesce(r.w, 1) * coalesce(d.w, 1)), 6))::BIGINT AS est
  FROM (SELECT DISTINCT wid FROM {workload}) wl, grid c
  LEFT JOIN weights r ON r.wid = wl.wid AND r.axis = 'number' AND r.b = c.i
  LEFT JOIN weights d ON d.wid = wl.wid AND d.axis = 'date' AND d.b = c.j
  GROUP BY wl.wid
)"""


SURVIVORS = """
survivors AS (
  SELECT wid, count_if(ok) AS survivors FROM (
    SELECT wid, item_id, bool_and(ok) AS ok FROM (
      SELECT wid, seq, item_id, bool_or(CASE op WHEN '>' THEN x > v WHEN '>=' THEN x >= v WHEN '<' THEN x < v WHEN '<=' THEN x <= v ELSE x = v END) AS ok
      FROM (SELECT wid, seq, op, v, item_id, CASE axis WHEN 'number' THEN number ELSE date END AS x FROM workload, axes)
      GROUP BY wid, seq, item_id
    ) GROUP BY wid, item_id
  ) GROUP BY wid
)"""

PREDICATE_TEXT = """
texts AS (
  SELECT kind, wid, string_agg(part, ', ' ORDER BY seq) AS predicates FROM (
    SELECT kind, wid, seq, CASE axis WHEN 'number' THEN 'token_count ' ELSE 'revdate ' END || op || ' ' ||
      CASE WHEN op = 'IN' THEN '[' || string_agg(v::BIGINT::VARCHAR, ', ' ORDER BY v) || ']'
           WHEN axis = 'number' THEN min(v)::BIGINT::VARCHAR
           ELSE strftime(make_timestamp((min(v) * 1000000)::BIGINT), '%Y-%m-%d %H:%M:%S') END AS part
    FROM workload GROUP BY kind, wid, seq, axis, op
  ) GROUP BY kind, wid
)"""

PASSES = "token_count < 500 AND revdate >= TIMESTAMP '2024-01-01 06:00:00'"


def hashed(source: str, key: str, name: str) -> str:
    """Unit vectors of hashed token counts as 32-bit floats."""
    return f"""
{name}_counts AS (
  SELECT {key} AS id, ('0x' || substr(md5(t), 1, 7))::BIGINT % {DIM} AS pos, count(*) AS c
  FROM (SELECT {key}, unnest(string_split_regex(lower(text), '[ \\t\\n\\v\\f\\r]+')) AS t FROM {source}) WHERE t <> '' GROUP BY ALL
),
{name} AS (
  SELECT id, list((c / (norm + 1e-12))::FLOAT ORDER BY pos) AS v FROM (
    SELECT s.{key} AS id, r.pos, coalesce(c, 0)::DOUBLE AS c, sqrt(sum(coalesce(c, 0) * coalesce(c, 0)) OVER (PARTITION BY s.{key})) AS norm
    FROM {source} s CROSS JOIN range({DIM}) r(pos) LEFT JOIN {name}_counts k ON k.id = s.{key} AND k.pos = r.pos
  ) GROUP BY id
)"""


DOC_ITEMS = f"""{DOCS}, {hashed('documents', 'doc_id', 'hashed_docs')},
items AS (
  SELECT docs.* EXCLUDE (text), {unit('h.v')} AS embedding FROM docs JOIN hashed_docs h ON h.id = docs.item_id
)"""

# ------------------------------------------------------------------------------------- sources, sinks, ingest

ORACLES["source_first_n"] = "SELECT * FROM orders ORDER BY o_orderkey LIMIT 1000"

ORACLES["csv_roundtrip"] = f"""WITH {DOCS}
SELECT item_id::VARCHAR AS item_id, title, text, coalesce(url, '') AS url, strftime(revdate, '%Y-%m-%d %H:%M:%S') AS revdate,
       token_count::VARCHAR AS token_count, entity FROM docs"""

ORACLES["csv_foreign"] = "SELECT doc_id, 'say \"' || lang || '\" \\nabla' || chr(10) || ', ' AS title, text FROM documents"
ORACLES["csv_escaped"] = "SELECT doc_id, '\"\\\\nabla' || chr(10) || text AS text FROM documents"

ORACLES["source_file_order"] = "SELECT * FROM orders LIMIT 1000"

ORACLES["items_build"] = f"""WITH {DOCS}
SELECT item_id, ext_id, title, coalesce(url, '') AS url, revdate, token_count, entity FROM docs"""

ORACLES["items_load"] = f"""WITH {DOCS}
SELECT entity, count(*) AS n, sum(token_count)::BIGINT AS tokens, min(revdate) AS first_date, max(item_id) AS last_id
FROM docs GROUP BY entity"""

ORACLES["value_to_text"] = """
WITH roles AS (
  SELECT conv_id AS doc_id, array_to_string(list_sort(list(DISTINCT role)), '; ') AS categories, max(turn) AS turns
  FROM conversations GROUP BY conv_id
)
SELECT d.doc_id::VARCHAR AS doc_id, d.text, d.lang, coalesce(categories, '') AS categories,
       CASE WHEN l.doc_id IS NULL THEN '' ELSE '{"quality":' || coalesce(l.quality::VARCHAR, 'null') || ',"toxic":' || coalesce(l.toxic::VARCHAR, 'null') || '}' END AS marks,
       coalesce(turns::VARCHAR, '') AS turns, '' AS absent
FROM documents d LEFT JOIN roles r USING (doc_id) LEFT JOIN labels l ON l.doc_id = d.doc_id"""

ORACLES["date_normalize"] = """
SELECT event_id, CASE event_id % 5 WHEN 1 THEN date_trunc('minute', ts) WHEN 2 THEN date_trunc('day', ts)::TIMESTAMP
  WHEN 4 THEN NULL ELSE date_trunc('second', ts) END AS revdate FROM events"""

ORACLES["assign_item_ids"] = """
SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS item_id, o_orderkey, o_totalprice FROM orders"""

ORACLES["pk_violations"] = """
SELECT l_orderkey AS item_id, count(*) AS copies FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1"""

ORACLES["count_items"] = f"WITH {ITEMS} SELECT count(*) AS n FROM items"

ORACLES["block_shuffle"] = f"""
SELECT event_id, event_id // 1000 AS block,
  event_id // 1000 * 1000 + row_number() OVER (PARTITION BY event_id // 1000 ORDER BY md5('{SEED}:' || event_id), event_id) - 1 AS position
FROM events"""

ORACLES["train_sample"] = f"""
SELECT o_orderkey, o_custkey FROM orders ORDER BY md5('{SEED}:' || o_orderkey), o_orderkey LIMIT 600"""

ORACLES["point_lookup"] = f"WITH {ITEMS} SELECT {ITEM_COLUMNS} FROM items WHERE item_id = 7"

ORACLES["display_projection"] = f"""WITH {ITEMS}, {prototypes('0')},
scored AS (SELECT q.qid, i.item_id, {similarity('q.qvec', 'i.embedding')} AS similarity FROM queries q, items i),
best AS ({top('scored', 20)})
SELECT item_id, title, revdate, token_count, similarity FROM best JOIN items USING (item_id)"""

# ------------------------------------------------------------------------------------------------- predicates

for _name, _where in {
    "pred_empty": "true",
    "pred_id_eq": "item_id = 1",
    "pred_id_gt": "item_id > 5",
    "pred_id_le": "item_id <= 10",
    "pred_token_lt": "token_count < 150",
    "pred_date_ge": "revdate >= TIMESTAMP '2024-01-01 06:00:00'",
    "pred_id_in": "item_id IN (1, 2, 3, 4, 5, 10000000)",
    "pred_id_in_empty": "false",
    "pred_and_range": "token_count > 100 AND token_count < 1000 AND revdate >= TIMESTAMP '2024-01-01 00:00:00'",
}.items():
    ORACLES[_name] = f"WITH {ITEMS} SELECT {ITEM_COLUMNS} FROM items WHERE {_where}"

_PREDICATES = """
preds AS (
  SELECT event_id, ts,
    CASE event_type WHEN 'view' THEN 'token_count' WHEN 'click' THEN 'revdate' WHEN 'error' THEN 'item_id'
      WHEN 'signup' THEN 'title' WHEN 'purchase' THEN 'revdate' END AS key,
    ['=', '>', '<', '>=', '<=', 'IN', '!='][user_id % 7 + 1] AS operator,
    event_id % 2 = 0 AS is_list, event_id % 5 AS layout
  FROM events
)"""

ORACLES["predicate_validate"] = f"""WITH {_PREDICATES}
SELECT event_id, key, operator, is_list,
  CASE WHEN key IS NULL OR key NOT IN ('item_id', 'revdate', 'token_count') THEN 'key'
       WHEN operator NOT IN ('=', '>', '<', '>=', '<=', 'IN') THEN 'operator'
       WHEN operator = 'IN' AND NOT is_list THEN 'list'
       WHEN key = 'revdate' AND NOT is_list AND layout IN (3, 4) THEN 'date' END AS problem
FROM preds"""

ORACLES["predicate_dates"] = """
SELECT event_id, CASE event_id % 5 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('minute', ts)
  WHEN 2 THEN date_trunc('day', ts)::TIMESTAMP END AS normalized FROM events"""

_BIG_WORKLOAD = f"{BIG}, {axis_edges('big')}, {WORKLOAD}"

ORACLES["workload_survivors"] = f"WITH {_BIG_WORKLOAD}, {SURVIVORS} SELECT wid, survivors FROM survivors"

ORACLES["workload_union"] = f"WITH {_BIG_WORKLOAD}, {PREDICATE_TEXT} SELECT wid, kind, predicates FROM texts"

ORACLES["workload_grid"] = f"""WITH {_BIG_WORKLOAD}, {PREDICATE_TEXT}
SELECT wid, predicates, k, method FROM texts,
  (SELECT unnest([5, 10, 50, 100, 200, 500, 1000, 2500, 5000, 6000, 7000, 10000]) AS k),
  (SELECT unnest(['base_pre_search', 'adap_pre_search', 'base_pos_search', 'adap_pos_search']) AS method)
WHERE kind IN ('single', 'dual')"""

# ------------------------------------------------------------------------------------------------- histogram

_BIG_EDGES = f"{BIG}, {axis_edges('big')}"

ORACLES["hist2d_edges"] = f"WITH {_BIG_EDGES} SELECT axis, edge_index, round(value, 6) AS value FROM edges"
ORACLES["hist2d_counts"] = f"WITH {_BIG_EDGES} SELECT i, j, n FROM grid"
ORACLES["hist2d_save_load"] = ORACLES["hist2d_counts"]

ORACLES["hist2d_rectangle"] = f"""WITH {_BIG_EDGES},
spans AS (
  SELECT len(list_filter(numbers, lambda x: x < 100000)) AS n0, len(list_filter(numbers, lambda x: x <= 300000)) AS n1,
         len(list_filter(dates, lambda x: x < epoch(TIMESTAMP '1996-06-01'))) AS d0, len(list_filter(dates, lambda x: x <= epoch(TIMESTAMP '1999-06-01'))) AS d1
  FROM lists
)
SELECT coalesce(sum(n), 0)::BIGINT AS rectangle FROM cells, spans WHERE i >= n0 AND i < n1 AND j >= d0 AND j < d1"""

ORACLES["hist2d_estimate"] = f"""WITH {_BIG_EDGES},
asked(wid, seq, axis, op, v) AS (
  VALUES (1, 1, 'number', '>=', 123456::DOUBLE), (1, 2, 'date', '<', epoch(TIMESTAMP '1997-03-05 12:00:00')::DOUBLE)
), {estimates('asked')}
SELECT est FROM estimates"""

ORACLES["hist2d_estimate_workload"] = f"WITH {_BIG_WORKLOAD}, {estimates()} SELECT wid, est FROM estimates"

ORACLES["hist2d_summary"] = f"""WITH {_BIG_EDGES}
SELECT sum(n)::BIGINT AS total, max(n) AS max_count, min(n) AS min_count, count_if(n > 0) AS non_empty_bins,
  round(100 * count_if(n > 0) / 100::DOUBLE, 6) AS non_empty_pct, round(sum(n) / 100::DOUBLE, 6) AS avg_per_bin,
  round(sum(n) / count_if(n > 0), 6) AS avg_per_non_empty_bin FROM grid"""

_WIDE = ", ".join(f"sum(n) FILTER (j = {j})::BIGINT AS d{j}" for j in range(10))
ORACLES["hist2d_table"] = f"""WITH {_BIG_EDGES}
SELECT i, CASE WHEN i = 0 THEN '≤' || round_even(any_value(hi), 0)::BIGINT
  ELSE '(' || round_even(any_value(lo), 0)::BIGINT || ', ≤' || round_even(any_value(hi), 0)::BIGINT || ')' END AS token_range, {_WIDE}
FROM grid JOIN bins ON bins.axis = 'number' AND bins.b = i GROUP BY i"""

ORACLES["hist2d_date_labels"] = f"""WITH {_BIG_EDGES},
days AS (
  SELECT b AS j, strftime(make_timestamp((floor(lo) * 1000000)::BIGINT), '%Y-%m-%d') AS lo,
    strftime(make_timestamp((floor(hi) * 1000000)::BIGINT), '%Y-%m-%d') AS hi FROM bins WHERE axis = 'date'
)
SELECT j, CASE WHEN j = 0 THEN '≤' || hi ELSE '(' || lo || ', ≤' || hi || ')' END AS label FROM days"""

ORACLES["hist2d_edges_df"] = f"""WITH {_BIG_EDGES}
SELECT edge_index, round(value, 6) AS revdate_ts, strftime(make_timestamp((floor(value) * 1000000)::BIGINT), '%Y-%m-%d %H:%M:%S') AS revdate_str
FROM edges WHERE axis = 'date'"""

ORACLES["est_vs_actual"] = f"""WITH {_BIG_WORKLOAD}, {PREDICATE_TEXT}, {estimates()}, {SURVIVORS}
SELECT wid, predicates, est, survivors AS actual, est - survivors AS error,
  CASE WHEN survivors > 0 THEN round(abs(est - survivors) / survivors, 6) END AS relative_error
FROM texts JOIN estimates USING (wid) JOIN survivors USING (wid) WHERE kind IN ('single', 'dual')"""

# ----------------------------------------------------------------------------------------- exact vector search

ORACLES["l2_normalize"] = """
WITH scaled AS (SELECT vec_id, list_transform(embedding, lambda x: (x * (label + 1))::FLOAT)::DOUBLE[] AS v FROM embeddings)
SELECT vec_id, (generate_subscripts(v, 1) - 1)::INT AS pos,
  round(unnest(list_transform(v, lambda x: (x / (sqrt(list_dot_product(v, v)) + 1e-12))::FLOAT))::DOUBLE, 6) AS x FROM scaled"""

for _name, _source, _key, _id in (
    ("embed_text", "documents", "doc_id", "doc_id"),
    ("embed_queries", "benchmark", "item_id", "qid"),
):
    ORACLES[_name] = f"""WITH {hashed(_source, _key, 'hashed')},
flat AS (SELECT id, (generate_subscripts(v, 1) - 1)::INT AS pos, unnest(v)::DOUBLE AS x FROM hashed)
SELECT id AS {_id}, pos, round(x, 6) AS x FROM flat WHERE x <> 0"""

ORACLES["knn_exact"] = f"""WITH {ITEMS}, {prototypes('0')},
scored AS (SELECT q.qid, i.item_id, {similarity('q.qvec', 'i.embedding')} AS similarity FROM queries q, items i),
best AS ({top('scored', 25)}) SELECT {RANKED} FROM best"""

ORACLES["knn_exact_batch"] = f"""
WITH vectors AS (SELECT vec_id AS item_id, {unit('embedding')} AS embedding FROM embeddings),
scored AS (SELECT q.item_id AS qid, i.item_id, {similarity('q.embedding', 'i.embedding')} AS similarity FROM vectors q, vectors i WHERE q.item_id % 20 = 0),
best AS ({top('scored', K)}) SELECT {RANKED} FROM best"""

ORACLES["knn_id_filtered"] = f"""WITH {ITEMS}, {prototypes()},
scored AS (
  SELECT q.qid, i.item_id, {similarity('q.qvec', 'i.embedding')} AS similarity FROM queries q, items i
  WHERE i.item_id IN (SELECT doc_id FROM labels WHERE quality = 1)
),
best AS ({top('scored', K)}) SELECT {RANKED} FROM best"""

ORACLES["intersect"] = f"""WITH {ITEMS}, {prototypes()},
scored AS (SELECT q.qid, i.item_id, {similarity('q.qvec', 'i.embedding')} AS similarity FROM queries q, items i),
best AS ({top('scored', 50)})
SELECT qid, item_id, title, token_count, similarity FROM best JOIN items USING (item_id) WHERE {PASSES}"""

# ------------------------------------------------------------------------------------------------------ cells

ORACLES["ivf_assign"] = f"WITH {ITEMS}, {coarse()} SELECT item_id, cell_id FROM placed"

_SIZES = "sizes AS (SELECT s.cell_id, count(p.item_id) AS n FROM seeds s LEFT JOIN placed p USING (cell_id) GROUP BY s.cell_id)"
ORACLES["ivf_cell_sizes"] = f"WITH {ITEMS}, {coarse()}, {_SIZES} SELECT cell_id, n FROM sizes"

ORACLES["ivf_save_load"] = f"""WITH {ITEMS}, {coarse()}, {_SIZES}
SELECT cell_id, n, (SELECT count(*) FROM items) AS total, (SELECT n FROM nlist)::INT AS nlist FROM sizes"""

ORACLES["ivf_probe"] = f"""WITH {ITEMS}, {coarse()}, {prototypes()}, {CELL_RANKS}
SELECT qid, cell_rank::INT AS rank, cell_id, cell_sim AS similarity FROM cell_ranks WHERE cell_rank <= {NPROBE}"""

ORACLES["ivf_probe_tree"] = f"""WITH {DOC_ITEMS}, {fine()}
SELECT i.item_id, row_number() OVER (PARTITION BY i.item_id ORDER BY {similarity('i.embedding', 's.centroid')} DESC, s.cell_id)::INT AS rank, s.cell_id
FROM items i, seeds s QUALIFY rank <= {NPROBE}"""

_IVF = f"{ITEMS}, {coarse()}, {prototypes()}, {scored()}"

ORACLES["ivf_search"] = f"""WITH {_IVF}, best AS ({top('scored', K, f'cell_rank <= {NPROBE}')}) SELECT {RANKED} FROM best"""

ORACLES["recall_at_k"] = f"""WITH {_IVF}, found AS ({top('scored', K, f'cell_rank <= {NPROBE}')}), wanted AS ({top('scored', K)})
SELECT w.qid, round(count(f.item_id) / count(*), 6) AS recall FROM wanted w LEFT JOIN found f ON f.qid = w.qid AND f.item_id = w.item_id GROUP BY w.qid"""

ORACLES["kmeans_step"] = f"""WITH {ITEMS}, {seeds('16')},
coords AS (
  SELECT cell_id, pos, avg(x) AS x, count(*) AS members FROM (
    SELECT cell_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM placed JOIN items USING (item_id)
  ) GROUP BY cell_id, pos
),
norms AS (SELECT cell_id, sqrt(sum(x * x)) + 1e-12 AS norm FROM coords GROUP BY cell_id)
SELECT cell_id, members, pos::INT AS pos, round(x / norm, 6) AS x FROM coords JOIN norms USING (cell_id)"""

# ------------------------------------------------------------------------------------------------------ codes

_RESIDUALS = f"""{ITEMS}, {coarse()},
residuals AS (
  SELECT item_id, cell_id, list_transform(list_zip(embedding, centroid), lambda z: z[1] - z[2]) AS residual
  FROM placed JOIN items USING (item_id)
),
books AS (
  SELECT (row_number() OVER (ORDER BY md5('{SEED}:' || item_id), item_id) - 1)::INT AS j, residual FROM residuals
  WHERE len(list_filter(residual, lambda x: abs(x) > 1e-9)) > 0 QUALIFY j < {CODES}
),
codewords AS (SELECT m::INT AS m, j, list_slice(residual, m * {WIDTH} + 1, m * {WIDTH} + {WIDTH}) AS word FROM books, range({PQ_M}) t(m)),
parts AS (SELECT item_id, cell_id, m::INT AS m, list_slice(residual, m * {WIDTH} + 1, m * {WIDTH} + {WIDTH}) AS part FROM residuals, range({PQ_M}) t(m)),
codes AS (
  SELECT p.item_id, p.cell_id, p.m, c.j, p.part, c.word FROM parts p JOIN codewords c ON c.m = p.m
  QUALIFY row_number() OVER (PARTITION BY p.item_id, p.m ORDER BY round(list_distance(part, word) ** 2, 9), c.j) = 1
)"""

ORACLES["pq_encode"] = f"WITH {_RESIDUALS} SELECT item_id, cell_id, m, j FROM codes"

ORACLES["pq_codebook_step"] = f"""WITH {_RESIDUALS},
means AS (
  SELECT m, j, pos, avg(x) AS x, count(*) AS members FROM (
    SELECT m, j, unnest(part) AS x, generate_subscripts(part, 1) - 1 AS pos FROM codes
  ) GROUP BY m, j, pos
),
old AS (SELECT m, j, unnest(word) AS x, generate_subscripts(word, 1) - 1 AS pos FROM codewords)
SELECT o.m, o.j, coalesce(members, 0) AS members, o.pos::INT AS pos, round(coalesce(n.x, o.x), 6) AS x
FROM old o LEFT JOIN means n ON n.m = o.m AND n.j = o.j AND n.pos = o.pos"""

_CODED = f"""{_RESIDUALS}, {prototypes()}, {CELL_RANKS},
approx AS (
  SELECT q.qid, c.item_id, round(any_value(r.cell_sim) + sum(list_dot_product(list_slice(q.qvec, c.m * {WIDTH} + 1, c.m * {WIDTH} + {WIDTH}), c.word)), 9) AS similarity
  FROM queries q JOIN cell_ranks r ON r.qid = q.qid AND r.cell_rank <= {NPROBE} JOIN codes c ON c.cell_id = r.cell_id
  GROUP BY q.qid, c.item_id
)"""

ORACLES["pq_adc_search"] = f"WITH {_CODED}, best AS ({top('approx', K)}) SELECT {RANKED} FROM best"

ORACLES["pq_rerank"] = f"""WITH {_CODED}, listed AS ({top('approx', 5 * K)}),
exact AS (
  SELECT l.qid, l.item_id, {similarity('q.qvec', 'i.embedding')} AS similarity FROM listed l JOIN queries q USING (qid) JOIN items i USING (item_id)
),
best AS ({top('exact', K)}) SELECT {RANKED} FROM best"""

# ---------------------------------------------------------------------------------------------- hybrid methods

ORACLES["probe_params_pre"] = """
WITH sizes AS (
  SELECT o_orderkey, o_custkey * 7 + 1 AS survivors, o_orderkey % 1000 + 1 AS k_remaining, o_orderkey % 13 AS old_nprobe FROM orders
)
SELECT *, greatest(1, least(512, (3 * k_remaining * 512) // (2 * survivors) + 3 * old_nprobe)) AS nprobe FROM sizes"""

ORACLES["probe_params_pos"] = """
WITH sizes AS (
  SELECT o_orderkey, o_custkey * 7 AS est, o_orderkey % 1000 + 1 AS k_remaining, o_orderkey % 17 * 50 AS old_search_k FROM orders
),
sized AS (
  SELECT *, CASE WHEN est = 0 THEN 150000 ELSE least(150000, floor(1.5::DOUBLE * k_remaining * 150000 / greatest(est, 1))::BIGINT + 3 * old_search_k) END AS search_k FROM sizes
)
SELECT *, CASE WHEN est = 0 THEN 512 ELSE least(512, greatest(1, (search_k * 512) // greatest(est, 1))) END AS nprobe FROM sized"""

_FINE = f"{ITEMS}, {fine()}, {prototypes()}, {scored()}"

_REACH = f"""
reach AS (
  SELECT r.qid, r.cell_rank, sum(coalesce(c.n, 0)) OVER (PARTITION BY r.qid ORDER BY r.cell_rank)::BIGINT AS seen
  FROM cell_ranks r LEFT JOIN (SELECT cell_id, count(*) AS n FROM placed JOIN items USING (item_id) WHERE {PASSES} GROUP BY cell_id) c USING (cell_id)
),
goals AS (SELECT qid, max(seen) AS survivors, least({K}, max(seen)) AS search_k FROM reach GROUP BY qid HAVING max(seen) > 0)"""

_BASE_WIDTHS = """
widths AS (
  SELECT g.qid, min(least(w.width, l.n)) AS nprobe FROM goals g, nlist l, (VALUES (64), (192), (576), (1000000000)) w(width)
  JOIN reach r ON r.qid = g.qid AND r.cell_rank = least(w.width, l.n)
  WHERE r.seen >= g.search_k GROUP BY g.qid
)"""

_ADAPTIVE_WIDTHS = """
walk AS (
  WITH RECURSIVE steps AS (
    SELECT qid, 0::BIGINT AS nprobe, 0::BIGINT AS found, 0 AS step FROM goals
    UNION ALL
    SELECT s.qid, r.cell_rank, least(g.search_k, r.seen), s.step + 1
    FROM steps s JOIN goals g ON g.qid = s.qid AND s.found < g.search_k CROSS JOIN nlist l
    JOIN reach r ON r.qid = s.qid
      AND r.cell_rank = greatest(1, least(l.n, (3 * (g.search_k - s.found) * l.n) // (2 * g.survivors) + 3 * s.nprobe))
  )
  SELECT * FROM steps
),
widths AS (SELECT w.qid, w.nprobe FROM walk w JOIN goals g USING (qid) WHERE w.found >= g.search_k)"""

_PRE_BEST = f"""
within AS (SELECT s.* FROM scored s JOIN widths w ON w.qid = s.qid AND s.cell_rank <= w.nprobe WHERE {PASSES}),
best AS ({top('within', K)})"""


def pos_rounds(sizes_first: str, sizes_next: str, rounds: int) -> str:
    """Rounds of the search-then-filter loop, written out one after the other."""
    parts = []
    for r in range(rounds):
        source = f"(SELECT q.qid, g.*, {K} AS remaining, 0::BIGINT AS old_k FROM queries q, given g)" if r == 0 else (
            f"(SELECT qid, n, lists, est, {K} - found AS remaining, search_k AS old_k FROM round{r - 1} WHERE found < {K} AND search_k < n)"
        )
        sizes = sizes_first if r == 0 else sizes_next
        parts.append(f"""
sizes{r} AS (SELECT *, {sizes} FROM {source}),
full{r} AS (SELECT * EXCLUDE (nprobe), CASE WHEN search_k >= n THEN lists ELSE nprobe END AS nprobe FROM sizes{r}),
hits{r} AS (
  SELECT qid, item_id, similarity, row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, item_id) AS rank FROM (
    SELECT s.*, f.search_k, row_number() OVER (PARTITION BY s.qid ORDER BY similarity DESC, item_id) AS place
    FROM scored s JOIN full{r} f ON f.qid = s.qid AND s.cell_rank <= f.nprobe
  ) WHERE place <= search_k AND {PASSES}
),
round{r} AS (SELECT f.*, (SELECT count(*) FROM hits{r} h WHERE h.qid = f.qid) AS found FROM full{r} f)""")
    best = " UNION ALL ".join(
        f"SELECT h.* FROM hits{r} h JOIN round{r} d ON d.qid = h.qid AND (d.found >= {K} OR d.search_k >= d.n) WHERE h.rank <= {K}"
        for r in range(rounds)
    )
    return ",".join(parts) + f", best AS ({best})"


_BASE_POS = f"""
given AS (SELECT (SELECT count(*) FROM items) AS n, (SELECT n FROM nlist) AS lists, 0 AS est), """ + pos_rounds(
    "100::BIGINT AS search_k, least(64, lists) AS nprobe",
    "least(n, old_k * 3) AS search_k, least(lists, CASE old_k WHEN 100 THEN 192 ELSE 1000000000 END) AS nprobe",
    6,
)

_J7 = """CASE WHEN est = 0 THEN n ELSE least(n, floor(1.5::DOUBLE * remaining * n / greatest(est, 1))::BIGINT + 3 * old_k) END AS search_k,
  CASE WHEN est = 0 THEN lists ELSE least(lists, greatest(1, (search_k * lists) // greatest(est, 1))) END AS nprobe"""

_ADAP_POS = f"""{axis_edges('items')},
asked(wid, seq, axis, op, v) AS (
  VALUES (1, 1, 'number', '<', 500::DOUBLE), (1, 2, 'date', '>=', epoch(TIMESTAMP '2024-01-01 06:00:00')::DOUBLE)
), {estimates('asked')},
given AS (SELECT (SELECT count(*) FROM items) AS n, (SELECT n FROM nlist) AS lists, (SELECT est FROM estimates) AS est), """ + pos_rounds(
    _J7, _J7, 8
)

_SHOWN = f"""SELECT b.qid, b.rank, b.item_id, i.title, i.revdate, i.token_count, b.similarity,
  count(*) OVER (PARTITION BY b.qid) = {K} AS is_k FROM best b JOIN items i USING (item_id)"""

_METHOD_STEPS = {
    "base_pre": f"{_REACH}, {_BASE_WIDTHS}, {_PRE_BEST}",
    "adap_pre": f"{_REACH}, {_ADAPTIVE_WIDTHS}, {_PRE_BEST}",
    "base_pos": _BASE_POS,
    "adap_pos": _ADAP_POS,
}
for _name, _steps in _METHOD_STEPS.items():
    ORACLES[f"hybrid_{_name}"] = f"WITH {_FINE}, {_steps} {_SHOWN}"

_ALL = ", ".join(
    f"{_name}_search AS (WITH {_steps} SELECT qid, item_id FROM best)" for _name, _steps in _METHOD_STEPS.items()
)
_NAMES = [f"{name}_search" for name in _METHOD_STEPS]
_PAIRS = " UNION ALL ".join(
    f"""SELECT q.qid, '{a}' AS method_a, '{b}' AS method_b, (SELECT count(*) FROM {a} x WHERE x.qid = q.qid) AS found_a,
    (SELECT count(*) FROM {b} x WHERE x.qid = q.qid) AS found_b,
    (SELECT count(*) FROM {a} x JOIN {b} y ON y.qid = x.qid AND y.item_id = x.item_id WHERE x.qid = q.qid) AS overlap FROM queries q"""
    for i, a in enumerate(_NAMES)
    for b in _NAMES[i + 1 :]
)
ORACLES["hybrid_compare"] = f"WITH {_FINE}, {_ALL} {_PAIRS}"

_ORDERED = ", ".join(
    f"{_name}_search AS (WITH {_steps} SELECT qid, item_id, rank FROM best)" for _name, _steps in _METHOD_STEPS.items()
)
_ORDER_PAIRS = " UNION ALL ".join(
    f"""SELECT q.qid, '{a}' AS method_a, '{b}' AS method_b, (SELECT count(*) FROM {a} x WHERE x.qid = q.qid) AS found_a,
    (SELECT count(*) FROM {b} x WHERE x.qid = q.qid) AS found_b,
    (SELECT count(*) FROM {a} x JOIN {b} y ON y.qid = x.qid AND y.item_id = x.item_id WHERE x.qid = q.qid) AS overlap,
    (SELECT min(coalesce(x.rank, y.rank))::INT FROM (SELECT * FROM {a} WHERE qid = q.qid) x FULL JOIN (SELECT * FROM {b} WHERE qid = q.qid) y
      ON y.rank = x.rank WHERE x.item_id IS DISTINCT FROM y.item_id) AS first_difference,
    (SELECT count(*) FROM {a} x JOIN {b} y ON y.qid = x.qid AND y.item_id = x.item_id JOIN {a} v ON v.qid = x.qid AND v.rank > x.rank
      JOIN {b} w ON w.qid = v.qid AND w.item_id = v.item_id AND w.rank < y.rank WHERE x.qid = q.qid) AS inversions FROM queries q"""
    for i, a in enumerate(_NAMES)
    for b in _NAMES[i + 1 :]
)
ORACLES["hybrid_compare_order"] = f"WITH {_FINE}, {_ORDERED} {_ORDER_PAIRS}"

ORACLES["workload_sweep"] = f"""WITH {ITEMS},
lists AS (
  SELECT 1 AS wid, count(*) AS survivors FROM items WHERE {PASSES} UNION ALL SELECT 2, count(*) FROM items WHERE token_count >= 1000
),
labels_used AS (SELECT count(DISTINCT label) AS n FROM embeddings)
SELECT wid, k, method, n * least(k, survivors) AS found, CASE WHEN survivors >= k THEN n ELSE 0 END AS full_queries
FROM lists, labels_used, (SELECT unnest([5, 50]) AS k),
  (SELECT unnest(['base_pre_search', 'adap_pre_search', 'base_pos_search', 'adap_pos_search']) AS method)"""

# Every list, k and method: the steps above with the list and k as further keys.
_KS = "[5, 10, 50, 100, 200, 500, 1000, 2500, 5000, 6000, 7000, 10000]"
_LIST_PASSES = """
passing AS (
  SELECT wid, item_id FROM (
    SELECT wid, seq, item_id, bool_or(CASE op WHEN '>' THEN x > v WHEN '>=' THEN x >= v WHEN '<' THEN x < v WHEN '<=' THEN x <= v ELSE x = v END) AS ok
    FROM (SELECT wid, seq, op, v, item_id, CASE axis WHEN 'number' THEN number ELSE date END AS x FROM workload, axes)
    GROUP BY wid, seq, item_id
  ) GROUP BY wid, item_id HAVING bool_and(ok)
)"""
_GRID_REACH = f"""
per_cell AS (SELECT wid, cell_id, count(*) AS n FROM passing JOIN placed USING (item_id) GROUP BY wid, cell_id),
reach AS (
  SELECT r.qid, w.wid, r.cell_rank, sum(coalesce(c.n, 0)) OVER (PARTITION BY r.qid, w.wid ORDER BY r.cell_rank)::BIGINT AS seen
  FROM cell_ranks r CROSS JOIN (SELECT DISTINCT wid FROM workload) w LEFT JOIN per_cell c ON c.cell_id = r.cell_id AND c.wid = w.wid
),
goals AS (
  SELECT qid, wid, k, max(seen) AS survivors, least(k, max(seen)) AS search_k FROM reach, (SELECT unnest({_KS}) AS k)
  GROUP BY qid, wid, k HAVING max(seen) > 0
)"""
_GRID_BASE_WIDTHS = """
base_widths AS (
  SELECT g.qid, g.wid, g.k, min(least(w.width, l.n)) AS nprobe FROM goals g, nlist l, (VALUES (64), (192), (576), (1728), (1000000000)) w(width)
  JOIN reach r ON r.qid = g.qid AND r.wid = g.wid AND r.cell_rank = least(w.width, l.n)
  WHERE r.seen >= g.search_k GROUP BY g.qid, g.wid, g.k
)"""
_GRID_ADAPTIVE_WIDTHS = """
adap_walk AS (
  WITH RECURSIVE steps AS (
    SELECT qid, wid, k, 0::BIGINT AS nprobe, 0::BIGINT AS found, 0 AS step FROM goals
    UNION ALL
    SELECT s.qid, s.wid, s.k, r.cell_rank, least(g.search_k, r.seen), s.step + 1
    FROM steps s JOIN goals g ON g.qid = s.qid AND g.wid = s.wid AND g.k = s.k AND s.found < g.search_k CROSS JOIN nlist l
    JOIN reach r ON r.qid = s.qid AND r.wid = s.wid
      AND r.cell_rank = greatest(1, least(l.n, (3 * (g.search_k - s.found) * l.n) // (2 * g.survivors) + 3 * s.nprobe))
  )
  SELECT * FROM steps
),
adap_widths AS (SELECT w.qid, w.wid, w.k, w.nprobe FROM adap_walk w JOIN goals g USING (qid, wid, k) WHERE w.found >= g.search_k)"""


def _grid_pre(name: str) -> str:
    return f"""
{name}_pre AS (
  SELECT w.qid, w.wid, w.k, s.item_id, row_number() OVER (PARTITION BY w.qid, w.wid, w.k ORDER BY similarity DESC, s.item_id) AS rank
  FROM {name}_widths w JOIN passing p USING (wid) JOIN scored s ON s.qid = w.qid AND s.item_id = p.item_id AND s.cell_rank <= w.nprobe
  QUALIFY rank <= w.k
)"""


def _grid_pos(name: str, est: str, first: str, following: str, rounds: int) -> str:
    """Rounds of search and filter for all lists and k; candidates are placed once for each query and width."""
    parts = []
    for r in range(rounds):
        source = (
            f"(SELECT q.qid, l.wid, unnest({_KS}) AS k, n, lists, {est} AS est, 0::BIGINT AS old_k, 0::BIGINT AS found FROM queries q, given JOIN listed l ON true)"
            if r == 0
            else f"(SELECT qid, wid, k, n, lists, est, search_k AS old_k, found FROM {name}_round{r - 1} WHERE found < k AND search_k < n)"
        )
        parts.append(f"""
{name}_sized{r} AS (SELECT * EXCLUDE (found), k - found AS remaining FROM {source}),
{name}_full{r} AS (
  SELECT * EXCLUDE (nprobe), CASE WHEN search_k >= n THEN lists ELSE nprobe END AS nprobe FROM (SELECT *, {first if r == 0 else following} FROM {name}_sized{r})
),
{name}_places{r} AS (
  SELECT s.qid, f.nprobe, s.item_id, row_number() OVER (PARTITION BY s.qid, f.nprobe ORDER BY similarity DESC, s.item_id) AS place
  FROM (SELECT DISTINCT qid, nprobe FROM {name}_full{r}) f JOIN scored s ON s.qid = f.qid AND s.cell_rank <= f.nprobe
),
{name}_hits{r} AS (
  SELECT f.qid, f.wid, f.k, p.item_id, row_number() OVER (PARTITION BY f.qid, f.wid, f.k ORDER BY place) AS rank
  FROM {name}_full{r} f JOIN passing a USING (wid) JOIN {name}_places{r} p ON p.qid = f.qid AND p.nprobe = f.nprobe AND p.item_id = a.item_id AND p.place <= f.search_k
),
{name}_round{r} AS (
  SELECT f.*, coalesce(h.n_hits, 0) AS found FROM {name}_full{r} f LEFT JOIN (SELECT qid, wid, k, count(*) AS n_hits FROM {name}_hits{r} GROUP BY ALL) h USING (qid, wid, k)
)""")
    best = " UNION ALL ".join(
        f"SELECT h.* FROM {name}_hits{r} h JOIN {name}_round{r} d USING (qid, wid, k) WHERE (d.found >= h.k OR d.search_k >= d.n) AND h.rank <= h.k"
        for r in range(rounds)
    )
    return ",".join(parts) + f", {name}_pos AS ({best})"


ORACLES["workload_sweep_ids"] = f"""WITH {DOC_ITEMS}, {seeds('SELECT 4 * floor(sqrt(count(*))) FROM items')}, {prototypes()}, {scored()},
{axis_edges('items')}, {WORKLOAD}, {estimates()}, {_LIST_PASSES}, {_GRID_REACH}, {_GRID_BASE_WIDTHS}, {_GRID_ADAPTIVE_WIDTHS},
listed AS (SELECT wid, est FROM estimates),
given AS (SELECT (SELECT count(*) FROM items) AS n, (SELECT n FROM nlist) AS lists),
{_grid_pre('base')}, {_grid_pre('adap')},
{_grid_pos('base', '0', '100::BIGINT AS search_k, least(64, lists) AS nprobe', "least(n, old_k * 3) AS search_k, least(lists, CASE old_k WHEN 100 THEN 192 WHEN 300 THEN 576 ELSE 1000000000 END) AS nprobe", 6)},
{_grid_pos('adap', 'l.est', _J7, _J7, 8)}
SELECT qid, wid::INT AS wid, k::INT AS k, method, count(*) AS found, count(*) = k AS is_k, md5(string_agg(item_id, ',' ORDER BY rank)) AS ids FROM (
  SELECT qid, wid, k, rank, item_id, 'base_pre_search' AS method FROM base_pre
  UNION ALL SELECT qid, wid, k, rank, item_id, 'adap_pre_search' FROM adap_pre
  UNION ALL SELECT qid, wid, k, rank, item_id, 'base_pos_search' FROM base_pos
  UNION ALL SELECT qid, wid, k, rank, item_id, 'adap_pos_search' FROM adap_pos
) GROUP BY qid, wid, k, method"""

_SERVICE_PASSES = "token_count < 400 AND revdate >= TIMESTAMP '2024-01-01 03:00:00'"
ORACLES["hybrid_service"] = f"""WITH {DOC_ITEMS}, {hashed('benchmark', 'item_id', 'hashed_queries')},
queries AS (SELECT id AS qid, {unit('v')} AS qvec FROM hashed_queries), {coarse()}, {scored()},
{_REACH}, {_ADAPTIVE_WIDTHS}, {_PRE_BEST} {_SHOWN}""".replace(PASSES, _SERVICE_PASSES)

ORACLES["telemetry_rollup"] = """
WITH rows AS (
  SELECT ['BASE_PRE', 'ADAP_PRE', 'BASE_POS', 'ADAP_POS'][user_id % 4 + 1] AS method, user_id AS run_id, event_type, value AS ms FROM events
),
runs AS (
  SELECT method, run_id, count_if(event_type = 'view') AS iterations, sum(ms) + 1 AS total,
    coalesce(sum(ms) FILTER (event_type = 'click'), 0) AS db_search, 0::DOUBLE AS histo_filter,
    coalesce(sum(ms) FILTER (event_type = 'view'), 0) AS faiss_search, coalesce(sum(ms) FILTER (event_type = 'error'), 0) AS ud_params,
    coalesce(sum(ms) FILTER (event_type = 'signup'), 0) AS intersect_, coalesce(sum(ms) FILTER (event_type = 'purchase'), 0) AS finalize
  FROM rows GROUP BY method, run_id
),
sums AS (
  SELECT method, count(*) AS num_runs, min(iterations) AS iterations, min(iterations) = max(iterations) AS iterations_consistent,
    sum(total) AS total, sum(db_search) AS db_search, sum(histo_filter) AS histo_filter, sum(faiss_search) AS faiss_search,
    sum(ud_params) AS ud_params, sum(intersect_) AS intersect_, sum(finalize) AS finalize FROM runs GROUP BY method
)
SELECT method, num_runs, iterations, iterations_consistent, round(total / num_runs, 6) AS total, round(db_search / num_runs, 6) AS db_search,
  round(histo_filter / num_runs, 6) AS histo_filter, round(faiss_search / num_runs, 6) AS faiss_search, round(ud_params / num_runs, 6) AS ud_params,
  round(intersect_ / num_runs, 6) AS "intersect", round(finalize / num_runs, 6) AS finalize,
  round(greatest(0, total - (db_search + histo_filter + faiss_search + ud_params + intersect_ + finalize)) / num_runs, 6) AS residual
FROM sums"""

_RUN_PASSES = {
    1: ("token_count < 500, revdate >= 2024-01-01 06:00:00", "token_count < 500 AND revdate >= TIMESTAMP '2024-01-01 06:00:00'"),
    2: ("token_count >= 300", "token_count >= 300"),
    3: ("", "true"),
    4: ("item_id IN []", "false"),
}
_RUN_CASE = "CASE {0} " + " ".join(f"WHEN {w} THEN ({where})" for w, (_, where) in _RUN_PASSES.items()) + " END"
_RUN_LISTS = "lists(wid, predicates) AS (VALUES " + ", ".join(f"({w}, '{text}')" for w, (text, _) in _RUN_PASSES.items()) + ")"

ORACLES["telemetry_frame"] = f"""WITH {DOC_ITEMS}, {_RUN_LISTS},
survivors AS (SELECT l.wid, count_if({_RUN_CASE.format('l.wid')}) AS survivors FROM lists l, items GROUP BY l.wid),
rows AS (
  SELECT ['BASE_PRE', 'ADAP_PRE', 'BASE_POS', 'ADAP_POS'][user_id % 4 + 1] AS method, user_id % 4 + 1 AS wid, [3, 10, 25][user_id % 3 + 1] AS k,
    user_id AS run_id, event_type, value AS ms FROM events
),
runs AS (
  SELECT method, wid, k, run_id, count_if(event_type = 'view') AS iterations, sum(ms) + 1 AS total, sum(ms) AS measured,
    coalesce(sum(ms) FILTER (event_type = 'click'), 0) AS db_search, coalesce(sum(ms) FILTER (event_type = 'view'), 0) AS faiss_search
  FROM rows GROUP BY ALL
)
SELECT method, wid::INT AS wid, k::INT AS k, any_value(predicates) AS predicates, any_value(survivors) AS survivors, count(*) AS num_runs,
  min(iterations) AS iterations, min(iterations) = max(iterations) AS iterations_consistent, round(avg(total), 6) AS total,
  round(avg(db_search), 6) AS db_search, round(avg(faiss_search), 6) AS faiss_search,
  round(greatest(0, sum(total) - sum(measured)) / count(*), 6) AS residual
FROM runs JOIN lists USING (wid) JOIN survivors USING (wid) GROUP BY method, wid, k"""

ORACLES["workload_search"] = f"""WITH {DOC_ITEMS}, {hashed('benchmark', 'item_id', 'hashed_queries')},
queries AS (SELECT id AS qid, {unit('v')} AS qvec FROM hashed_queries), {_RUN_LISTS},
scored AS (
  SELECT q.qid * 10 + l.wid AS eid, [3, 10, 25][q.qid % 3 + 1] AS k, i.item_id, {similarity('q.qvec', 'i.embedding')} AS similarity
  FROM queries q, lists l, items i WHERE {_RUN_CASE.format('l.wid')}
),
best AS (
  SELECT *, row_number() OVER (PARTITION BY eid ORDER BY similarity DESC, item_id) AS rank FROM scored QUALIFY rank <= k
)
SELECT eid, rank::INT AS rank, item_id, similarity, count(*) OVER (PARTITION BY eid) = k AS is_k FROM best"""

# --------------------------------------------------------------------------------------------- build and stream

ORACLES["incremental_add"] = f"""WITH {DOC_ITEMS}, {seeds('16')}
SELECT p.item_id, p.cell_id, i.token_count FROM placed p JOIN items i USING (item_id)"""

ORACLES["incremental_store"] = f"""WITH {_RESIDUALS.replace(ITEMS, DOC_ITEMS).replace(coarse(), seeds('16'))}
SELECT i.item_id, i.title, i.url, i.revdate, i.token_count, i.entity, c.cell_id, string_agg(c.j, ',' ORDER BY c.m) AS codes
FROM codes c JOIN items i USING (item_id) GROUP BY ALL"""

# ----------------------------------------------------------- the same results by the ways taken beyond a size bound

for _name, _same in {
    "pred_id_in_long": "pred_id_in",
    "knn_exact_joined": "knn_exact",
    "ivf_search_joined": "ivf_search",
    "ivf_search_blocks": "ivf_search",
    "ivf_assign_joined": "ivf_assign",
    "hybrid_base_pos_counted": "hybrid_base_pos",
}.items():
    ORACLES[_name] = ORACLES[_same]

# ---------------------------------------------------------------- what trained results must satisfy, whatever they are

ORACLES["ivf_train"] = f"""WITH {ITEMS}
SELECT count(*) AS stored, count(DISTINCT item_id) AS ids, 0::BIGINT AS misplaced, 16::BIGINT AS cells, 16::BIGINT AS unit,
  true AS better_than_seeds FROM items"""

ORACLES["ivf_build"] = """
SELECT count(*) AS stored, count(DISTINCT doc_id) AS ids, 0::BIGINT AS misplaced, 16::BIGINT AS cells, 16::BIGINT AS unit,
  0::BIGINT AS wrong_codes, count(*) AS total FROM documents"""

ORACLES["pq_train"] = f"""
SELECT m::INT AS m, {CODES}::BIGINT AS codes, {WIDTH}::INT AS width, true AS no_worse_than_seeds FROM range({PQ_M}) t(m)"""
