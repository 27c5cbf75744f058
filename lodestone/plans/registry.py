"""Named queries over the driver's tables, and the DuckDB statements that give the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import similarity as S
from lodestone.functions import vectors as V
from lodestone.operators import blocking, embeddings, matching, paths
from lodestone.plans.graph import FACT, FactGraph
from lodestone.plans.lineage import shared_folder
from lodestone.plans.patterns import parse
from lodestone.sources import formats

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return keep


# ---- the tables as facts

#: (predicate, subject kind, subject key, object kind or "" for a literal, object, table, whether rows repeat)
VIEW = (
    ("inRegion", "nation", "n_nationkey", "region", "n_regionkey", "nation", False),
    ("inNation", "customer", "c_custkey", "nation", "c_nationkey", "customer", False),
    ("inNation", "supplier", "s_suppkey", "nation", "s_nationkey", "supplier", False),
    ("segment", "customer", "c_custkey", "", "c_mktsegment", "customer", False),
    ("placedBy", "order", "o_orderkey", "customer", "o_custkey", "orders", False),
    ("brand", "part", "p_partkey", "", "p_brand", "part", False),
    ("contains", "order", "l_orderkey", "part", "l_partkey", "lineitem", True),
    ("supplies", "supplier", "l_suppkey", "part", "l_partkey", "lineitem", True),
)


def _term(kind: str, key: str):
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string")) if kind else F.col(key)


def facts(spark: SparkSession, sf_dir: str, only: set[str] | None = None) -> FactGraph:
    """The tables as a graph. Repeated rows are dropped where a table has them; different predicates can't repeat each other."""
    parts = []
    for predicate, sk, s, ok, o, table, repeats in VIEW:
        if only is None or predicate in only:
            rows = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(s, o)
            rows = rows.distinct() if repeats else rows
            parts.append(rows.select(_term(sk, s).alias("subject"), F.lit(predicate).alias("predicate"), _term(ok, o).alias("object")))
    return FactGraph(reduce(DataFrame.unionByName, parts), distinct=True)


def _sql_part(row) -> str:
    predicate, sk, s, ok, o, table, repeats = row
    obj = f"'{ok}:' || {o}" if ok else o
    return f"SELECT {'DISTINCT ' if repeats else ''}'{sk}:' || {s} AS s, '{predicate}' AS p, {obj} AS o FROM {table}"


T = "WITH RECURSIVE t AS (" + " UNION ALL ".join(map(_sql_part, VIEW)) + ") "


# ---- scans, look-ups, sets


@query("kg_scan", T + "SELECT s AS subject, p AS predicate, o AS object FROM t")
def kg_scan(spark, sf_dir):
    return facts(spark, sf_dir).facts


_BOUND = {"s": "customer:7", "p": "inNation", "o": "nation:3"}
for _key in ("spo", "sp", "po", "os", "s", "p", "o"):
    _terms = {c: _BOUND[c] for c in _key}
    if "s" in _key and "o" in _key:
        _terms |= {"s": "nation:3", "o": "region:3"} | ({"p": "inRegion"} if "p" in _key else {})
    _where = " AND ".join(f"{c} = '{v}'" for c, v in _terms.items())

    @query(f"kg_lookup_{_key}", T + f"SELECT s AS subject, p AS predicate, o AS object FROM t WHERE {_where}")
    def kg_lookup(spark, sf_dir, terms=_terms):
        return facts(spark, sf_dir).lookup(terms.get("s"), terms.get("p"), terms.get("o"))


@query("kg_subjects", T + "SELECT DISTINCT s AS subject FROM t")
def kg_subjects(spark, sf_dir):
    return facts(spark, sf_dir).subjects()


@query("kg_predicates", T + "SELECT DISTINCT p AS predicate FROM t")
def kg_predicates(spark, sf_dir):
    return facts(spark, sf_dir).predicates()


@query("kg_objects", T + "SELECT DISTINCT o AS object FROM t")
def kg_objects(spark, sf_dir):
    return facts(spark, sf_dir).objects()


@query("kg_entities", T + "SELECT s AS entity FROM t UNION SELECT o FROM t")
def kg_entities(spark, sf_dir):
    return facts(spark, sf_dir).entities()


@query("kg_predicate_statistics", T + "SELECT p AS predicate, count(*) AS facts, count(DISTINCT s) AS subjects, count(DISTINCT o) AS objects FROM t GROUP BY p")
def kg_predicate_statistics(spark, sf_dir):
    return facts(spark, sf_dir).predicate_statistics()


@query(
    "kg_cardinality",
    T + "SELECT 'all' AS given, count(*) AS n FROM t UNION ALL SELECT 'p', count(*) FROM t WHERE p = 'inNation' "
    "UNION ALL SELECT 'po', count(*) FROM t WHERE p = 'inNation' AND o = 'nation:3' UNION ALL SELECT 'spo', count(*) FROM t WHERE s = 'customer:7' AND p = 'segment'",
)
def kg_cardinality(spark, sf_dir):
    """With all three given the object is left out of the estimate."""
    given = {"all": ("", "", ""), "p": ("", "inNation", ""), "po": ("", "inNation", "nation:3"), "spo": ("customer:7", "segment", "no such")}
    g = facts(spark, sf_dir)
    counts = g.counts([parse_terms(*t) for t in given.values()])
    return spark.createDataFrame(list(zip(given, counts, strict=True)), "given string, n long")


def parse_terms(s: str, p: str, o: str):
    from lodestone.plans.patterns import Pattern

    return Pattern(s or "?s", p or "?p", o or "?o")


@query("kg_contains", T + "SELECT EXISTS(SELECT 1 FROM t WHERE s = 'nation:3' AND p = 'inRegion' AND o = 'region:3') AS yes, EXISTS(SELECT 1 FROM t WHERE s = 'nation:3' AND p = 'inRegion' AND o = '') AS no")
def kg_contains(spark, sf_dir):
    g = facts(spark, sf_dir, {"inRegion"})
    return spark.createDataFrame([(g.contains("nation:3", "inRegion", "region:3"), g.contains("nation:3", "inRegion", ""))], "yes boolean, no boolean")


_NEW = "SELECT 'nation:' || n_nationkey AS s, 'inRegion' AS p, 'region:' || ((n_regionkey + n_nationkey) % 5) AS o FROM nation"


def _more_facts(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    return n.select(_term("nation", "n_nationkey").alias("subject"), F.lit("inRegion").alias("predicate"), F.concat(F.lit("region:"), ((F.col("n_regionkey") + F.col("n_nationkey")) % 5).cast("string")).alias("object"))


@query("kg_insert", T + f"SELECT s AS subject, p AS predicate, o AS object FROM (SELECT * FROM t WHERE p = 'inRegion' UNION {_NEW})")
def kg_insert(spark, sf_dir):
    return facts(spark, sf_dir, {"inRegion"}).add_all(_more_facts(spark, sf_dir)).facts


@query("kg_insert_new", T + f"SELECT s AS subject, p AS predicate, o AS object FROM ({_NEW} EXCEPT SELECT * FROM t)")
def kg_insert_new(spark, sf_dir):
    return facts(spark, sf_dir).new_facts(_more_facts(spark, sf_dir))


@query("kg_delete", T + f"SELECT s AS subject, p AS predicate, o AS object FROM (SELECT * FROM t EXCEPT {_NEW})")
def kg_delete(spark, sf_dir):
    return facts(spark, sf_dir).remove_all(_more_facts(spark, sf_dir)).facts


# ---- text formats


@query("nt_export", T + """SELECT '<' || s || '> <' || p || '> "' || o || '" .' AS line FROM t""")
def nt_export(spark, sf_dir):
    return formats.nt_export(facts(spark, sf_dir))


@query("nt_roundtrip", T + "SELECT 'http://x.org/' || s AS subject, p AS predicate, CASE WHEN o LIKE '%:%' THEN 'http://x.org/' || o ELSE o END AS object FROM t")
def nt_roundtrip(spark, sf_dir):
    """Written as lines and read again."""
    iri = lambda c: F.concat(F.lit("http://x.org/"), c)
    g = facts(spark, sf_dir).facts.select(iri("subject").alias("subject"), "predicate", F.when(F.contains("object", F.lit(":")), iri("object")).otherwise(F.col("object")).alias("object"))
    lines = formats.nt_export(FactGraph(g, distinct=True)).select(F.col("line").alias("value"))
    return formats.nt_lines(lines).where("ok").select("subject", "predicate", "object")


@query(
    "jsonld_nodes",
    T + """, v AS (SELECT s, p, CASE WHEN count(*) = 1 THEN '"' || min(o) || '"' ELSE '[' || string_agg('"' || o || '"', ', ' ORDER BY o) || ']' END AS x FROM t GROUP BY s, p)
    SELECT s AS subject, '{"@id": "' || s || '", ' || string_agg('"' || p || '": ' || x, ', ' ORDER BY p) || '}' AS node FROM v GROUP BY s""",
)
def jsonld_nodes(spark, sf_dir):
    return formats.jsonld_nodes(facts(spark, sf_dir))


@query("jsonld_facts", T + """SELECT '{"@id":"' || s || '","' || p || '":"' || o || '"}' AS node FROM t""")
def jsonld_facts(spark, sf_dir):
    return facts(spark, sf_dir).facts.select(formats.fact_jsonld().alias("node"))


@query("ttl_parse", "SELECT 'http://n.org/' || n_nationkey AS subject, 'http://p.org/name' AS predicate, n_name AS object FROM nation")
def ttl_parse(spark, sf_dir):
    """Lines of one text with prefixes, as the Turtle reader has them for a file."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    lines = n.select(F.concat(F.lit("n:"), F.col("n_nationkey").cast("string"), F.lit(' p:name "'), "n_name", F.lit('" .')).alias("x"))
    text = lines.agg(F.concat(F.lit("@prefix n: <http://n.org/> .\n@prefix p: <http://p.org/> .\n"), F.array_join(F.collect_list("x"), "\n")).alias("value"))

    def read(frames):
        import pandas as pd

        for frame in frames:
            for value in frame["value"]:
                yield pd.DataFrame(list(formats.parse_turtle(value)), columns=FACT.fieldNames())

    return text.mapInPandas(read, FACT)


@query("load_count", T + f"SELECT (SELECT count(*) FROM ({_NEW} EXCEPT SELECT * FROM t)) AS added, (SELECT count(*) FROM (SELECT * FROM t WHERE p = 'inRegion' UNION {_NEW})) AS size")
def load_count(spark, sf_dir):
    graph, added = formats.load(facts(spark, sf_dir, {"inRegion"}), _more_facts(spark, sf_dir))
    return spark.createDataFrame([(added, graph.size())], "added long, size long")


for _fmt in ("nt", "jsonld"):

    @query(f"export_{_fmt}", T + (""" SELECT '<' || s || '> <' || p || '> "' || o || '" .' AS line FROM t WHERE p = 'inRegion'""" if _fmt == "nt" else """ SELECT '{"@id": "' || s || '", "inRegion": "' || o || '"}' AS line FROM t WHERE p = 'inRegion'"""))
    def export(spark, sf_dir, fmt=_fmt):
        return formats.export(facts(spark, sf_dir, {"inRegion"}), fmt)


@query("csv_records", "SELECT CAST(n_nationkey AS VARCHAR) AS record_id, n_name AS name FROM nation")
def csv_records(spark, sf_dir):
    """Written as CSV to the shared folder and read as records."""
    path = f"{shared_folder(spark)}/lodestone-csv-{uuid.uuid4().hex}"
    spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")).write.csv(path, header=True)
    return formats.read_records(spark, path, key="key")


@query("expand_prefixed", "SELECT 'http://s.org/' || s_suppkey AS iri, 'x:' || s_suppkey AS unknown FROM supplier")
def expand_prefixed(spark, sf_dir):
    names = formats.Namespaces({"s": "http://s.org/"})
    key = F.col("s_suppkey").cast("string")
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(names.column(F.concat(F.lit("s:"), key)).alias("iri"), names.column(F.concat(F.lit("<x:"), key, F.lit(">"))).alias("unknown"))


# ---- pattern queries

_PATTERNS = {
    "bgp_region_customers": (
        "SELECT ?c ?n WHERE { ?c inNation ?n . ?n inRegion region:1 }",
        "SELECT DISTINCT a.s AS c, a.o AS n FROM t a JOIN t b ON a.o = b.s WHERE a.p = 'inNation' AND b.p = 'inRegion' AND b.o = 'region:1'",
    ),
    "bgp_star": (
        "SELECT ?c ?n WHERE { ?c segment BUILDING . ?c inNation ?n }",
        "SELECT DISTINCT a.s AS c, b.o AS n FROM t a JOIN t b ON a.s = b.s WHERE a.p = 'segment' AND a.o = 'BUILDING' AND b.p = 'inNation'",
    ),
    "bgp_chain5": (
        "SELECT ?s ?c WHERE { ?s supplies ?p . ?o contains ?p . ?o placedBy ?c . ?s inNation ?n . ?c inNation ?n }",
        "SELECT DISTINCT a.s AS s, c.o AS c FROM t a JOIN t b ON a.o = b.o JOIN t c ON b.s = c.s JOIN t d ON d.s = a.s JOIN t e ON e.s = c.o AND e.o = d.o "
        "WHERE a.p = 'supplies' AND b.p = 'contains' AND c.p = 'placedBy' AND d.p = 'inNation' AND e.p = 'inNation'",
    ),
    "bgp_predvar": ("SELECT ?p ?o WHERE { customer:7 ?p ?o }", "SELECT DISTINCT p, o FROM t WHERE s = 'customer:7'"),
    "bgp_samevar": ("SELECT ?x ?p WHERE { ?x ?p ?x }", "SELECT DISTINCT s AS x, p FROM e WHERE s = o"),
    "bgp_cross": (
        "SELECT ?a ?b WHERE { ?a inRegion region:1 . ?b inRegion region:2 }",
        "SELECT DISTINCT a.s AS a, b.s AS b FROM t a, t b WHERE a.p = 'inRegion' AND a.o = 'region:1' AND b.p = 'inRegion' AND b.o = 'region:2'",
    ),
    "bgp_exists": (
        "SELECT ?n WHERE { ?n inRegion region:1 . customer:7 inNation ?m . nation:0 inRegion region:0 }",
        "SELECT DISTINCT a.s AS n FROM t a WHERE a.p = 'inRegion' AND a.o = 'region:1' AND EXISTS (SELECT 1 FROM t WHERE s = 'customer:7' AND p = 'inNation') "
        "AND EXISTS (SELECT 1 FROM t WHERE s = 'nation:0' AND p = 'inRegion' AND o = 'region:0')",
    ),
    "bgp_projection": ("SELECT ?n ?nosuch WHERE { ?c inNation ?n }", "SELECT DISTINCT o AS n FROM t WHERE p = 'inNation'"),
    "bgp_limit_offset": (
        "SELECT ?c ?n WHERE { ?c inNation ?n } LIMIT 20 OFFSET 5",
        "SELECT DISTINCT s AS c, o AS n FROM t WHERE p = 'inNation' ORDER BY c, n LIMIT 20 OFFSET 5",
    ),
    "bgp_limit0": ("SELECT ?c WHERE { ?c inNation nation:3 } LIMIT 0", "SELECT DISTINCT s AS c FROM t WHERE p = 'inNation' AND o = 'nation:3'"),
    "bgp_cycle": (
        "SELECT ?a ?b WHERE { ?a buysFrom ?b . ?b buysFrom ?c . ?c buysFrom ?a }",
        "SELECT DISTINCT x.s AS a, x.o AS b FROM e x JOIN e y ON x.o = y.s JOIN e z ON y.o = z.s AND z.o = x.s",
    ),
}

#: Supplier nations that an edge leads to from each customer nation.
PARTNERS = 4
E = (
    "WITH RECURSIVE e AS (SELECT 'nation:' || c AS s, 'buysFrom' AS p, 'nation:' || n AS o FROM (SELECT c_nationkey AS c, s_nationkey AS n, row_number() OVER (PARTITION BY c_nationkey ORDER BY sum(l_quantity) DESC, s_nationkey) AS k "
    "FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY c_nationkey, s_nationkey) "
    f"WHERE k <= {PARTNERS}) "
)


def trade(spark: SparkSession, sf_dir: str) -> FactGraph:
    """Customer nation buysFrom the supplier nations that it has most from, over all items: a graph with cycles."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    rows = read("lineitem").join(read("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(read("customer"), F.col("o_custkey") == F.col("c_custkey")).join(read("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    rows = rows.groupBy("c_nationkey", "s_nationkey").agg(F.sum("l_quantity").alias("q"))
    place = F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("q"), "s_nationkey"))
    rows = rows.withColumn("k", place).where(F.col("k") <= PARTNERS)
    return FactGraph(rows.select(_term("nation", "c_nationkey").alias("subject"), F.lit("buysFrom").alias("predicate"), _term("nation", "s_nationkey").alias("object")), distinct=True)


_TRADE = ("bgp_cycle", "bgp_samevar")
for _name, (_text, _sql) in _PATTERNS.items():

    @query(_name, (E if _name in _TRADE else T) + _sql)
    def bgp(spark, sf_dir, text=_text, graph=trade if _name in _TRADE else facts):
        return graph(spark, sf_dir).query(text)


@query(
    "plan_estimates",
    T + """, c AS (SELECT '?s supplies ?p' AS pattern, count(*) AS cardinality FROM t WHERE p = 'supplies' UNION ALL SELECT '?c inNation ?n', count(*) FROM t WHERE p = 'inNation'
    UNION ALL SELECT '?s inNation ?n', count(*) FROM t WHERE p = 'inNation' UNION ALL SELECT '?n inRegion region:1', count(*) FROM t WHERE p = 'inRegion' AND o = 'region:1')
    SELECT CASE pattern WHEN '?n inRegion region:1' THEN 0 WHEN '?c inNation ?n' THEN 1 WHEN '?s inNation ?n' THEN 2 ELSE 3 END AS step, pattern, cardinality,
    cardinality / (SELECT count(*) FROM t) AS selectivity, CAST((SELECT sum(cardinality) FROM c) AS DOUBLE) AS cost FROM c""",
)
def plan_estimates(spark, sf_dir):
    return facts(spark, sf_dir).plan(parse("SELECT ?c WHERE { ?s supplies ?p . ?c inNation ?n . ?s inNation ?n . ?n inRegion region:1 }"))


# ---- paths


def _hops(source: str, depth: int, extra: str = "") -> str:
    return f", h(node, d) AS (SELECT CAST('{source}' AS VARCHAR), 0 UNION SELECT g.o, d + 1 FROM h JOIN g ON g.s = h.node WHERE d < {depth}{extra}) "


_WALK = {"placedBy", "contains", "inNation", "inRegion"}
_WALK_SQL = T + ", g AS (SELECT s, o FROM t WHERE p IN ('placedBy', 'contains', 'inNation', 'inRegion'))"


@query("hop_k", _WALK_SQL + _hops("order:10", 3) + "SELECT node, CAST(min(d) AS INT) AS distance FROM h WHERE node <> 'order:10' GROUP BY node")
def hop_k(spark, sf_dir):
    return paths.within(facts(spark, sf_dir, _WALK), "order:10", 3)


@query("hop_k_relations", T + ", g AS (SELECT s, o FROM t WHERE p = 'placedBy' OR p = 'inNation')" + _hops("order:10", 2) + "SELECT DISTINCT node FROM h WHERE node <> 'order:10'")
def hop_k_relations(spark, sf_dir):
    return paths.neighbours(facts(spark, sf_dir), "order:10", 2, {"placedBy", "inNation"})


@query("hop_k_cycle", E + ", g AS (SELECT s, o FROM e)" + _hops("nation:13", 4) + "SELECT node, CAST(min(d) AS INT) AS distance FROM h WHERE node <> 'nation:13' GROUP BY node")
def hop_k_cycle(spark, sf_dir):
    return paths.within(trade(spark, sf_dir), "nation:13", 4)


@query(
    "reachable",
    E + ", g AS (SELECT s, o FROM e)" + _hops("nation:13", 10) + ", n AS (SELECT 'nation:14' AS target UNION ALL SELECT 'nation:20' UNION ALL SELECT 'nowhere') SELECT target, target IN (SELECT node FROM h) AS reachable FROM n",
)
def reachable(spark, sf_dir):
    g = trade(spark, sf_dir)
    return spark.createDataFrame([(x, paths.reachable(g, "nation:13", x)) for x in ("nation:14", "nation:20", "nowhere")], "target string, reachable boolean")


@query("shortest_length", E + ", g AS (SELECT s, o FROM e)" + _hops("nation:13", 6) + "SELECT 'nation:13' AS source, 'nation:14' AS target, CAST(coalesce(min(d), -1) AS INT) AS length FROM h WHERE node = 'nation:14'")
def shortest_length(spark, sf_dir):
    return paths.shortest_path(trade(spark, sf_dir), "nation:13", "nation:14", 6).select("source", "target", "length")


@query(
    "shortest_undirected",
    T + ", g AS (SELECT s, o FROM t WHERE p IN ('inNation', 'placedBy', 'contains', 'supplies') UNION SELECT o, s FROM t WHERE p IN ('inNation', 'placedBy', 'contains', 'supplies'))"
    + _hops("customer:7", 3) + "SELECT CAST(coalesce(min(d), -1) AS INT) AS length FROM h WHERE node = 'supplier:3'",
)
def shortest_undirected(spark, sf_dir):
    g = facts(spark, sf_dir)
    return paths.shortest_path(g, "customer:7", "supplier:3", 3, {"inNation", "placedBy", "contains", "supplies"}, directed=False).select("length")


@query(
    "simple_paths",
    E + ", w(node, seen, n) AS (SELECT CAST('nation:13' AS VARCHAR), ['nation:13'], 0 UNION ALL SELECT e.o, list_append(seen, e.o), n + 1 FROM w JOIN e ON e.s = w.node "
    "WHERE n < 4 AND NOT list_contains(seen, e.o) AND w.node <> 'nation:14') SELECT array_to_string(seen, '>') AS nodes, CAST(n AS INT) AS length FROM w WHERE node = 'nation:14'",
)
def simple_paths(spark, sf_dir):
    found = paths.simple_paths(trade(spark, sf_dir), "nation:13", "nation:14", 4)
    nodes = F.concat_ws(">", F.col("path")[0]["src"], F.array_join(F.transform("path", lambda h: h["dst"]), ">"))
    return found.select(nodes.alias("nodes"), "length")


# ---- records: tokens, signatures, candidates, matches, clusters


def _documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("record_id"), "text")


_WORDS = "SELECT DISTINCT doc_id, unnest(string_split_regex(lower(text), '\\s+')) AS w FROM documents"


@query("record_tokens", f"SELECT doc_id AS record_id, count(*) AS tokens FROM ({_WORDS}) WHERE w <> '' GROUP BY doc_id")
def record_tokens(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    return docs.select("record_id", F.size(blocking.record_tokens(docs)).cast("long").alias("tokens")).where("tokens > 0")


def _signature_sql(n: int) -> str:
    a, b = blocking.hash_family(n)
    rows = ", ".join(f"({i}, {x}, {y})" for i, (x, y) in enumerate(zip(a, b, strict=True)))
    word = lambda k: f"CAST(concat('0x', substr(md5(w), {8 * k + 1}, 8)) AS BIGINT)"
    return (
        f"WITH f(i, a, b) AS (VALUES {rows}), d AS ({_WORDS}), v AS (SELECT DISTINCT w FROM d WHERE w <> ''), "
        f"h AS (SELECT w, (8 * {word(0)} + 4 * {word(1)} + 2 * {word(2)} + {word(3)}) % 2147483647 AS h FROM v), "
        "m AS (SELECT doc_id, i, min((CAST(a AS BIGINT) * h + b) % 2147483647) AS x FROM d JOIN h USING (w) CROSS JOIN f GROUP BY doc_id, i) "
    )


@query("minhash_signatures", _signature_sql(20) + "SELECT doc_id AS record_id, string_agg(x, ',' ORDER BY i) AS signature FROM m GROUP BY doc_id")
def minhash_signatures(spark, sf_dir):
    return blocking.signatures(_documents(spark, sf_dir), 20).where("signature[0] > 0 or signature[1] > 0").select("record_id", F.array_join(F.col("signature").cast("array<string>"), ",").alias("signature"))


@query(
    "lsh_pairs",
    _signature_sql(100) + ", k AS (SELECT doc_id, i // 5 AS band, string_agg(x, ',' ORDER BY i) AS key FROM m GROUP BY doc_id, i // 5) "
    "SELECT DISTINCT a.doc_id AS id1, b.doc_id AS id2 FROM k a JOIN k b ON a.band = b.band AND a.key = b.key AND a.doc_id < b.doc_id",
)
def lsh_pairs(spark, sf_dir):
    return blocking.lsh_pairs(_documents(spark, sf_dir), 100, 20)


_CUSTOMERS = "(SELECT c_custkey AS id, c_name AS name, c_mktsegment AS city, lower(c_mktsegment || ' ' || c_name) AS k FROM customer)"
_NEAR = f"SELECT id, name, city, row_number() OVER (ORDER BY k, id) AS n FROM {_CUSTOMERS}"


def _customers(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("record_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("city"))


def _near(spark, sf_dir):
    records = _customers(spark, sf_dir)
    return records, blocking.neighbourhood_pairs(records, 5, F.lower(F.concat_ws(" ", "city", "name")))


@query("neighbourhood_pairs", f"WITH o AS ({_NEAR}) SELECT least(a.id, b.id) AS id1, greatest(a.id, b.id) AS id2 FROM o a JOIN o b ON b.n > a.n AND b.n - a.n < 5")
def neighbourhood_pairs(spark, sf_dir):
    return _near(spark, sf_dir)[1]


_PAIRED = f"WITH RECURSIVE o AS ({_NEAR}), c AS (SELECT a.id AS i, b.id AS j, a.name AS x, b.name AS y, a.city AS u, b.city AS v FROM o a JOIN o b ON b.n > a.n AND b.n - a.n < 5), "
_SIMILAR = (
    "s AS (SELECT least(i, j) AS id1, greatest(i, j) AS id2, 1 - levenshtein(x, y) / greatest(length(x), length(y)) AS name_score, CASE WHEN lower(u) = lower(v) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS city_score FROM c), "
    "m AS (SELECT *, 0.6 * name_score + 0.4 * city_score AS similarity FROM s)"
)


@query("match_candidates", _PAIRED + _SIMILAR + " SELECT id1, id2, round(similarity, 6) AS similarity, round(name_score, 6) AS name_score, city_score FROM m WHERE similarity >= 0.93")
def match_candidates(spark, sf_dir):
    """Scores in the table are multiples of 1/45 plus 0.4 or 0, so that 0.93 isn't one."""
    records, pairs = _near(spark, sf_dir)
    found = matching.Matcher(threshold=0.93).match(records, pairs)
    return found.select("id1", "id2", F.round("similarity", 6).alias("similarity"), F.round(F.col("field_scores")["name"], 6).alias("name_score"), F.col("field_scores")["city"].alias("city_score"))


_CLUSTERED = (
    _PAIRED + _SIMILAR + ", g AS (SELECT id1 AS a, id2 AS b FROM m WHERE similarity >= 0.965 UNION SELECT id2, id1 FROM m WHERE similarity >= 0.965), "
    "r(a, b) AS (SELECT id, id FROM o UNION SELECT r.a, g.b FROM r JOIN g ON r.b = g.a), l AS (SELECT a AS record_id, min(b) AS canonical_id FROM r GROUP BY a) "
)


@query("er_clusters", _CLUSTERED + "SELECT canonical_id, string_agg(record_id, ',' ORDER BY record_id) AS members FROM l GROUP BY canonical_id")
def er_clusters(spark, sf_dir):
    return _clusters(spark, sf_dir).select("canonical_id", F.array_join(F.col("member_ids").cast("array<string>"), ",").alias("members"))


def _clusters(spark, sf_dir):
    records, pairs = _near(spark, sf_dir)
    labels = matching.cluster_labels(records, matching.Matcher(threshold=0.965).match(records, pairs))
    return labels.groupBy("canonical_id").agg(F.sort_array(F.collect_list("record_id")).alias("member_ids"))


@query(
    "er_statistics",
    _CLUSTERED + ", z AS (SELECT count(*) AS n FROM l GROUP BY canonical_id) SELECT count(*) AS total_clusters, count(*) FILTER (n = 1) AS singletons, coalesce(max(n), 0) AS max_cluster_size, CAST(coalesce(sum(n), 0) AS BIGINT) AS total_records FROM z",
)
def er_statistics(spark, sf_dir):
    return matching.link_statistics(_clusters(spark, sf_dir))


@query("er_link", _CLUSTERED + """, w AS (SELECT canonical_id, string_agg(id1 || '-' || id2 || '=' || CAST(round(similarity, 6) AS DECIMAL(9, 6)), ',' ORDER BY id1, id2) AS matches FROM m JOIN l ON l.record_id = id1 WHERE similarity >= 0.965 GROUP BY canonical_id)
    SELECT canonical_id, string_agg(record_id, ',' ORDER BY record_id) AS members, coalesce(max(w.matches), '') AS matches FROM l LEFT JOIN w USING (canonical_id) GROUP BY canonical_id""")
def er_link(spark, sf_dir):
    """The linking pipeline in one call, blocked by the default key (all fields of the record), with its match lists."""
    records = _customers(spark, sf_dir).select("record_id", "city", "name")
    out = matching.link(records, matching.Matcher(threshold=0.965), method="snb", window=5)
    one = lambda m: F.concat(m["id1"].cast("string"), F.lit("-"), m["id2"].cast("string"), F.lit("="), F.round(m["similarity"], 6).cast("decimal(9,6)").cast("string"))
    return out.select("canonical_id", F.array_join(F.col("member_ids").cast("array<string>"), ",").alias("members"), F.array_join(F.transform("matches", one), ",").alias("matches"))


@query("default_key", "SELECT c_custkey AS record_id, lower(c_mktsegment || ' ' || c_name) AS key FROM customer")
def default_key(spark, sf_dir):
    records = _customers(spark, sf_dir).select("record_id", "city", "name")
    return records.select("record_id", blocking.default_key(records).alias("key"))


@query("match_own_similarity", _PAIRED[:-2] + " SELECT least(i, j) AS id1, greatest(i, j) AS id2, CAST(length(x) = length(y) AS INT)::DOUBLE AS similarity FROM c WHERE length(x) = length(y)")
def match_own_similarity(spark, sf_dir):
    """With a similarity of the caller's own: names of one length."""
    records, pairs = _near(spark, sf_dir)
    own = matching.Field("name", 1.0, lambda a, b: (F.length(a) == F.length(b)).cast("double"))
    return matching.Matcher([own], threshold=0.5).match(records, pairs).select("id1", "id2", "similarity")


@query(
    "similarities",
    """SELECT p_partkey, CAST(levenshtein(p_name, p_type) AS INT) AS distance, round(1 - levenshtein(p_name, p_type) / greatest(length(p_name), length(p_type)), 6) AS normalised,
    round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 6) AS jaccard
    FROM (SELECT *, list_distinct(string_split_regex(lower(p_name), '\\s+')) AS x, list_distinct(string_split_regex(lower(p_name || ' ' || p_type), '\\s+')) AS y FROM part)""",
)
def similarities(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.select("p_partkey", S.levenshtein("p_name", "p_type").alias("distance"), F.round(S.normalised_levenshtein("p_name", "p_type"), 6).alias("normalised"), F.round(S.token_jaccard("p_name", F.concat_ws(" ", "p_name", "p_type")), 6).alias("jaccard"))


# ---- embeddings: entities are the rows of the table, relations its ten smallest ids


def transe(spark, sf_dir, norm: int = 2):
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("int").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))
    return embeddings.TransE(v, v.where("id < 10"), embeddings.TransEConfig(dim=64, norm=norm))


def rotate(spark, sf_dir):
    v = transe(spark, sf_dir).entities.select("id", F.slice("vec", 1, 32).alias("re"), F.slice("vec", 33, 32).alias("im"))
    m = embeddings.RotatE(v, v.where("id < 10"), embeddings.RotatEConfig(dim=32))
    m.relations = m.project_relations()
    return m


def _triples(spark, sf_dir):
    """A triple for each row of the table; its number of rows folds the tails."""
    return _all_triples(spark, sf_dir)[0]


def _all_triples(spark, sf_dir):
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    n = v.count()
    return v.select(F.col("vec_id").cast("int").alias("h"), (F.col("vec_id") % 10).cast("int").alias("r"), ((F.col("vec_id") * 7 + 3) % n).cast("int").alias("t")), n


_V = "WITH v AS (SELECT CAST(vec_id AS INT) AS id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings), q AS (SELECT CAST(vec_id AS INT) AS h, CAST(vec_id % 10 AS INT) AS r, CAST((vec_id * 7 + 3) % (SELECT count(*) FROM embeddings) AS INT) AS t FROM embeddings), "
_DIFF = "list_transform(range(1, 65), lambda i: a.vec[i] + b.vec[i] - c.vec[i])"
_L1, _L2 = (f"-{x}" for x in (f"list_sum(list_transform({_DIFF}, lambda x: abs(x)))", f"sqrt(list_sum(list_transform({_DIFF}, lambda x: x * x)))"))
_FROM = " FROM q JOIN v a ON a.id = q.h JOIN v b ON b.id = q.r JOIN v c ON c.id = q.t"
_ROT = (
    "z AS (SELECT id, vec[1:32] AS re, vec[33:64] AS im FROM v), y AS (SELECT id, list_transform(range(1, 33), lambda i: re[i] / greatest(sqrt(re[i] * re[i] + im[i] * im[i]), 1e-8)) AS re, "
    "list_transform(range(1, 33), lambda i: im[i] / greatest(sqrt(re[i] * re[i] + im[i] * im[i]), 1e-8)) AS im FROM z WHERE id < 10) "
)
_ROT_SCORE = "-sqrt(list_sum(list_transform(range(1, 33), lambda i: power(a.re[i] * b.re[i] - a.im[i] * b.im[i] - c.re[i], 2) + power(a.re[i] * b.im[i] + a.im[i] * b.re[i] - c.im[i], 2))))"


@query("transe_score_l2", _V[:-2] + f" SELECT h, r, t, round({_L2}, 6) AS score" + _FROM)
def transe_score_l2(spark, sf_dir):
    return embeddings.score(transe(spark, sf_dir), _triples(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query("transe_score_l1", _V[:-2] + f" SELECT h, r, t, round({_L1}, 6) AS score" + _FROM)
def transe_score_l1(spark, sf_dir):
    return embeddings.score(transe(spark, sf_dir, 1), _triples(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query("rotate_score", _V + _ROT + f"SELECT h, r, t, round({_ROT_SCORE}, 6) AS score FROM q JOIN z a ON a.id = q.h JOIN y b ON b.id = q.r JOIN z c ON c.id = q.t")
def rotate_score(spark, sf_dir):
    return embeddings.score(rotate(spark, sf_dir), _triples(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query("relation_phases", _V + _ROT + "SELECT id, CAST(i AS INT) AS place, round(atan2(im[i], re[i]), 6) AS phase FROM y, range(1, 33) g(i)")
def relation_phases(spark, sf_dir):
    return rotate(spark, sf_dir).relation_phases().select("id", F.posexplode("phase").alias("place", "phase")).select("id", (F.col("place") + 1).alias("place"), F.round("phase", 6).alias("phase"))


@query("normalise", _V[:-2] + " SELECT id, CAST(i AS INT) AS place, round(vec[i] / greatest(sqrt(list_sum(list_transform(vec, lambda x: x * x))), 1e-8), 6) AS x FROM v, range(1, 65) g(i)")
def normalise(spark, sf_dir):
    e = transe(spark, sf_dir).normalise_entities()
    return e.select("id", F.posexplode("vec").alias("place", "x")).select("id", (F.col("place") + 1).alias("place"), F.round("x", 6).alias("x"))


@query("project_unit", _V + _ROT + "SELECT id, CAST(i AS INT) AS place, round(re[i], 6) AS re, round(im[i], 6) AS im FROM y, range(1, 33) g(i)")
def project_unit(spark, sf_dir):
    rel = rotate(spark, sf_dir).relations.select("id", F.posexplode(F.arrays_zip("re", "im")).alias("place", "x"))
    return rel.select("id", (F.col("place") + 1).alias("place"), F.round("x.re", 6).alias("re"), F.round("x.im", 6).alias("im"))


def _predict_sql(scored: str, prefix: str, ties: str, k: int) -> str:
    return _V[:-2] + f" SELECT id, '{prefix}' || id AS name, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY score DESC, id {ties}) AS INT) AS rank FROM ({scored}) ORDER BY score DESC, id {ties} LIMIT {k}"


@query("predict_tail", _predict_sql(f"SELECT c.id, {_L2} AS score FROM v a, v b, v c WHERE a.id = 17 AND b.id = 3", "entity_", "DESC", 10))
def predict_tail(spark, sf_dir):
    return embeddings.predict_tail(transe(spark, sf_dir), 17, 3).withColumn("score", F.round("score", 6))


@query("predict_head", _predict_sql(f"SELECT a.id, {_L2} AS score FROM v a, v b, v c WHERE b.id = 3 AND c.id = 42", "entity_", "DESC", 10))
def predict_head(spark, sf_dir):
    return embeddings.predict_head(transe(spark, sf_dir), 3, 42).withColumn("score", F.round("score", 6))


@query("predict_relation", _predict_sql(f"SELECT b.id, {_L2} AS score FROM v a, v b, v c WHERE a.id = 17 AND c.id = 42 AND b.id < 10", "rel_", "ASC", 5))
def predict_relation(spark, sf_dir):
    return embeddings.predict_relation(transe(spark, sf_dir), 17, 42).withColumn("score", F.round("score", 6))


_RANKS = _V + f"s AS (SELECT h, r, t, c.id AS e, {_L2} AS score FROM q JOIN v a ON a.id = q.h JOIN v b ON b.id = q.r, v c), k AS (SELECT x.h, x.r, x.t, greatest(count(*) FILTER (y.score >= x.score), 1) AS rank FROM s x JOIN s y ON x.h = y.h AND x.r = y.r AND x.t = y.t WHERE x.e = x.t GROUP BY x.h, x.r, x.t) "


@query("evaluate_ranks", _RANKS + "SELECT h, r, t, rank FROM k")
def evaluate_ranks(spark, sf_dir):
    return embeddings.ranks(transe(spark, sf_dir), _triples(spark, sf_dir))


@query("evaluate_metrics", _RANKS + "SELECT round(avg(1.0 / rank), 9) AS mrr, avg((rank <= 1)::INT) AS hits_at_1, avg((rank <= 3)::INT) AS hits_at_3, avg((rank <= 10)::INT) AS hits_at_10 FROM k")
def evaluate_metrics(spark, sf_dir):
    return embeddings.evaluate(transe(spark, sf_dir), _triples(spark, sf_dir)).withColumn("mrr", F.round("mrr", 9))


@query("transe_step", _V + f"""n AS (SELECT h, r, t, h AS nh, (t * 7 + 3) % (SELECT count(*) FROM embeddings) AS nt FROM q),
    x AS (SELECT n.*, list_transform(range(1, 65), lambda i: a.vec[i] + b.vec[i] - c.vec[i]) AS good, list_transform(range(1, 65), lambda i: d.vec[i] + b.vec[i] - f.vec[i]) AS bad
      FROM n JOIN v a ON a.id = h JOIN v b ON b.id = r JOIN v c ON c.id = t JOIN v d ON d.id = nh JOIN v f ON f.id = nt),
    k AS (SELECT * FROM x WHERE 1.0 + sqrt(list_sum(list_transform(good, lambda y: y * y))) - sqrt(list_sum(list_transform(bad, lambda y: y * y))) > 0),
    m AS (SELECT h AS id, i, -0.02 * good[i] AS d FROM k, range(1, 65) g(i) UNION ALL SELECT t, i, 0.02 * good[i] FROM k, range(1, 65) g(i)
      UNION ALL SELECT nh, i, 0.02 * bad[i] FROM k, range(1, 65) g(i) UNION ALL SELECT nt, i, -0.02 * bad[i] FROM k, range(1, 65) g(i)),
    u AS (SELECT v.id, g.i, vec[g.i] + coalesce(sum(d), 0) AS x FROM v CROSS JOIN range(1, 65) g(i) LEFT JOIN m ON m.id = v.id AND m.i = g.i GROUP BY v.id, g.i, vec)
    SELECT id, CAST(i AS INT) AS place, round(x / sqrt(sum(x * x) OVER (PARTITION BY id)), 6) AS x FROM u""")  # fmt: skip
def transe_step(spark, sf_dir):
    """One training step with fixed negatives: the entities after it."""
    return _places(transe(spark, sf_dir).step(_fixed_batch(spark, sf_dir))[0].entities, "vec", "x")


def _fixed_batch(spark, sf_dir):
    triples, n = _all_triples(spark, sf_dir)
    return triples.withColumn("nh", F.col("h")).withColumn("nt", ((F.col("t").cast("long") * 7 + 3) % n).cast("int"))


def _places(table, name, out):
    return table.select("id", F.posexplode(name).alias("place", "x")).select("id", (F.col("place") + 1).alias("place"), F.round("x", 6).alias(out))


_STEP = """n AS (SELECT h, r, t, h AS nh, (t * 7 + 3) % (SELECT count(*) FROM embeddings) AS nt FROM q),
    x AS (SELECT n.*, list_transform(range(1, 65), lambda i: a.vec[i] + b.vec[i] - c.vec[i]) AS good, list_transform(range(1, 65), lambda i: d.vec[i] + b.vec[i] - f.vec[i]) AS bad
      FROM n JOIN v a ON a.id = h JOIN v b ON b.id = r JOIN v c ON c.id = t JOIN v d ON d.id = nh JOIN v f ON f.id = nt),
    w AS (SELECT *, greatest(0, 1.0 + sqrt(list_sum(list_transform(good, lambda y: y * y))) - sqrt(list_sum(list_transform(bad, lambda y: y * y)))) AS loss FROM x)"""


@query("transe_step_relations", _V + _STEP + """, m AS (SELECT r AS id, i, -0.02 * good[i] AS d FROM w, range(1, 65) g(i) WHERE loss > 0)
    SELECT v.id, CAST(g.i AS INT) AS place, round(vec[g.i] + coalesce(sum(d), 0), 6) AS x FROM v CROSS JOIN range(1, 65) g(i) LEFT JOIN m ON m.id = v.id AND m.i = g.i WHERE v.id < 10 GROUP BY v.id, g.i, vec""")
def transe_step_relations(spark, sf_dir):
    """The relations after the same step."""
    return _places(transe(spark, sf_dir).step(_fixed_batch(spark, sf_dir))[0].relations, "vec", "x")


@query("transe_step_loss", _V + _STEP + " SELECT round(avg(loss), 6) AS loss FROM w")
def transe_step_loss(spark, sf_dir):
    return spark.createDataFrame([(round(transe(spark, sf_dir).step(_fixed_batch(spark, sf_dir))[1], 6),)], "loss double")


_GAP = "list_transform(range(1, 33), lambda i: {0}.re[i] * b.re[i] - {0}.im[i] * b.im[i] - {1}.re[i]) AS {2}re, list_transform(range(1, 33), lambda i: {0}.re[i] * b.im[i] + {0}.im[i] * b.re[i] - {1}.im[i]) AS {2}im"
_SIZE = "sqrt(list_sum(list_transform(range(1, 33), lambda i: {0}re[i] * {0}re[i] + {0}im[i] * {0}im[i])))"


@query("rotate_step", _V + _ROT + f""", n AS (SELECT h, r, t, h AS nh, (t * 7 + 3) % (SELECT count(*) FROM embeddings) AS nt FROM q),
    x AS (SELECT h, t, b.re AS rre, {_GAP.format("a", "c", "g")}, {_GAP.format("d", "f", "b")} FROM n JOIN z a ON a.id = h JOIN y b ON b.id = r JOIN z c ON c.id = t JOIN z d ON d.id = nh JOIN z f ON f.id = nt),
    k AS (SELECT * FROM x WHERE 6.0 + {_SIZE.format("g")} - {_SIZE.format("b")} > 0),
    m AS (SELECT h AS id, i, -0.01 * gre[i] * rre[i] AS dre, -0.01 * gim[i] * rre[i] AS dim FROM k, range(1, 33) g(i) UNION ALL SELECT t, i, 0.01 * gre[i], 0.01 * gim[i] FROM k, range(1, 33) g(i))
    SELECT z.id, CAST(g.i AS INT) AS place, round(re[g.i] + coalesce(sum(dre), 0), 6) AS re, round(im[g.i] + coalesce(sum(dim), 0), 6) AS im FROM z CROSS JOIN range(1, 33) g(i) LEFT JOIN m ON m.id = z.id AND m.i = g.i GROUP BY z.id, g.i, re, im""")
def rotate_step(spark, sf_dir):
    ents = rotate(spark, sf_dir).step(_fixed_batch(spark, sf_dir))[0].entities.select("id", F.posexplode(F.arrays_zip("re", "im")).alias("place", "x"))
    return ents.select("id", (F.col("place") + 1).alias("place"), F.round("x.re", 6).alias("re"), F.round("x.im", 6).alias("im"))


@query("rotate_initial", "SELECT CAST(vec_id AS INT) AS id, TRUE AS bounded, CAST(32 AS INT) AS parts FROM embeddings")
def rotate_initial(spark, sf_dir):
    """A start for every row of the table: each part is within 6 / sqrt(dim)."""
    n = spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    start = embeddings.RotatE.initial(spark, n, 10, embeddings.RotatEConfig(dim=32)).entities
    bounded = F.forall(F.concat("re", "im"), lambda x: F.abs(x) <= 6 / 32**0.5)
    return start.select("id", bounded.alias("bounded"), F.size("re").alias("parts"))


@query("transe_initial", "SELECT CAST(vec_id AS INT) AS id, CAST(1.0 AS DOUBLE) AS length FROM embeddings")
def transe_initial(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    start = embeddings.TransE.initial(spark, n, 10, embeddings.TransEConfig(dim=16)).entities
    return start.select("id", F.round(V.l2("vec"), 9).alias("length"))


@query("vector_getters", _V + _ROT + "SELECT 'transe' AS model, CAST(i AS INT) AS place, round(vec[i], 6) AS x, 0.0::DOUBLE AS y FROM v, range(1, 65) g(i) WHERE id = 17 UNION ALL SELECT 'rotate', CAST(i AS INT), round(re[i], 6), round(im[i], 6) FROM z, range(1, 33) g(i) WHERE id = 17")
def vector_getters(spark, sf_dir):
    rows = [("transe", k + 1, round(x, 6), 0.0) for k, x in enumerate(transe(spark, sf_dir).entity(17))]
    rows += [("rotate", k + 1, round(x.real, 6), round(x.imag, 6)) for k, x in enumerate(rotate(spark, sf_dir).entity(17))]
    return spark.createDataFrame(rows, "model string, place int, x double, y double")


@query("triple_score", _V[:-2] + f" SELECT round({_L2}, 6) AS score FROM v a, v b, v c WHERE a.id = 17 AND b.id = 3 AND c.id = 42")
def triple_score(spark, sf_dir):
    return spark.createDataFrame([(round(embeddings.triple_score(transe(spark, sf_dir), 17, 3, 42), 6),)], "score double")


@query("predict_named", _V[:-2] + f" SELECT id, CASE WHEN id % 2 = 0 THEN 'even ' || id ELSE 'entity_' || id END AS name, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY score DESC, id DESC) AS INT) AS rank FROM (SELECT c.id, {_L2} AS score FROM v a, v b, v c WHERE a.id = 17 AND b.id = 3) ORDER BY score DESC, id DESC LIMIT 10")
def predict_named(spark, sf_dir):
    """With a vocabulary that names half of the entities."""
    model = transe(spark, sf_dir)
    vocab = model.entities.where("id % 2 = 0").select("id", F.concat(F.lit("even "), F.col("id")).alias("name"))
    return embeddings.predict_tail(model, 17, 3, vocab=vocab).withColumn("score", F.round("score", 6))


@query("negative_sample", _V[:-2] + " SELECT h, r, t, 1 AS kept, TRUE AS within FROM q")
def negative_sample(spark, sf_dir):
    """Of each triple one end at least is kept, and what replaces the other is an entity."""
    triples, n = _all_triples(spark, sf_dir)
    drawn = embeddings.corrupt(triples, n)  # h, r, t, nh, nt
    kept = F.greatest((F.col("nh") == F.col("h")).cast("int"), (F.col("nt") == F.col("t")).cast("int"))
    return drawn.select("h", "r", "t", kept.alias("kept"), (F.col("nh").between(0, n - 1) & F.col("nt").between(0, n - 1)).alias("within"))


@query("train_transe")
def train_transe(spark, sf_dir):
    """Losses of a short training, by epoch."""
    triples, n = _all_triples(spark, sf_dir)
    model = embeddings.TransE.initial(spark, n, 10, embeddings.TransEConfig(dim=16))
    _, result = embeddings.train(model, triples, n, embeddings.TrainerConfig(epochs=2, batch_size=100))
    return spark.createDataFrame(list(enumerate(result.losses)), "epoch int, loss double")


