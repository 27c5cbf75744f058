"""Secret scans by a battery of randomness tests, in DataFrame functions only.

The base kinds are patterns. Beside them, each run of 16 or more characters of an encoding's alphabet
with at most two = at its end is tested if its encoding (hex, base 32, base 64) can be inferred; a run
that mixes base 64 and its variant for URLs is tested in the parts that either has: a uniformity statistic (the sum of
squared character counts, as in chi-squared), the number of changes between lower case, upper case and
other characters (runs), and the correlation of neighbours. Each is turned into a deviation from what
word-like strings show at that length; the deviations are added (Stouffer) and give a p-value of the
hypothesis that the string is word-like. A string must also not be refuted as random by chi-squared
and serial correlation. Benjamini and Hochberg's procedure controls the false discoveries in each band of
lengths, over a table of at most bands x bins counts.

Positions are code points. A kind's matches are found left to right without overlap; their places
come from running sums over the lengths of the parts between them.

Defined cases: a null text is empty; a null doc_id is carried along; repeated rows get equal rows; an
empty table gives no rows; a text of any length is read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.shared import settle

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: The rest of these two patterns can't begin inside a failing match, so the least length may stand in them.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
RUN = r"[A-Za-z0-9+/_-]{16,}={0,2}"
#: The parts of a run that holds characters of both base 64 and base 64 for URLs.
PARTS = (r"[A-Za-z0-9+/]{16,}={0,2}", r"[A-Za-z0-9_-]{16,}={0,2}")
KINDS = ("assign", "access", "hex", "random")
FALSE_DISCOVERIES = 0.001
#: Lower ends of the bands of lengths.
BANDS = (16, 24, 32, 48, 96)
#: p-values are counted by tenths of their negative decimal logarithm, up to this.
BINS = 300
#: Word-like strings: chance that two characters agree, that neighbours differ in class; largest serial correlation of a random one.
AGREE, CHANGE, SERIAL = 0.066, 0.2, 0.5
#: The first of these for strings of hex digits, such as numbers and dates.
AGREE_HEX = 0.115


#: Elements of an array that are gathered one after the other; longer arrays are scanned by such blocks.
SCANNED = 64
SPAN = "struct<start:int,end:int,from:int,to:int,hit:string>"


def let(value: Column, use) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def running(values: Column, op, kind: str) -> Column:
    """The running ``op`` (associative) of an array. Appending copies an array, so it is done within blocks
    of SCANNED elements and once more over the blocks' last elements."""
    none = F.array().cast(f"array<{kind}>")

    def scan(xs: Column) -> Column:
        return F.aggregate(xs, none, lambda acc, x: F.concat(acc, F.array(F.when(F.size(acc) > 0, op(F.try_element_at(acc, F.lit(-1)), x)).otherwise(x))))

    def over(xs: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(1), F.size(xs), F.lit(SCANNED)), lambda s: scan(F.slice(xs, s, F.lit(SCANNED))))
        return let(blocks, lambda bs: let(scan(F.transform(bs, lambda b: F.element_at(b, -1))), lambda before: joined(bs, before)))

    def joined(bs: Column, before: Column) -> Column:
        return F.flatten(F.transform(bs, lambda b, i: F.when(i == 0, b).otherwise(let(F.get(before, i - 1), lambda y: F.transform(b, lambda x: op(y, x))))))

    return let(F.col(values) if isinstance(values, str) else values, lambda xs: F.when(F.size(xs) > 0, over(xs)).otherwise(none))


def places(text: Column, pattern: str) -> Column:
    """start, end (code points), from, to (bytes) and text of each match of pattern."""
    gaps = F.split(text, pattern, -1)
    plus = lambda a, b: F.struct((a["at"] + b["at"]).alias("at"), (a["byte"] + b["byte"]).alias("byte"))
    def steps(hits):
        return F.zip_with(
            F.slice(gaps, F.lit(1), F.size(hits)), hits,
            lambda gap, hit: F.struct((F.length(gap) + F.length(hit)).alias("at"), (F.octet_length(gap) + F.octet_length(hit)).alias("byte")),
        )

    def span(hit, end):
        from_, start = end["byte"] - F.octet_length(hit), end["at"] - F.length(hit)
        return F.struct(start.alias("start"), end["at"].alias("end"), from_.alias("from"), end["byte"].alias("to"), hit.alias("hit"))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda hits: F.zip_with(hits, running(steps(hits), plus, "struct<at:int,byte:int>"), span))


def _none() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def found(text: Column, pattern: str, gate: str | None = None) -> Column:
    """places(), without the work for texts that don't hold the pattern."""
    return F.when(F.rlike(text, F.lit(gate or pattern)), places(text, pattern)).otherwise(_none())


def split_mixed(runs: str) -> Column:
    """The runs, those of mixed alphabets as their parts; a part of both alphabets stands once."""

    def parts(x):
        at = {"start": "start", "end": "start", "from": "from", "to": "from"}
        shift = lambda p: F.struct(*[(x[base] + p[name]).alias(name) for name, base in at.items()], p["hit"].alias("hit"))
        either = F.array_distinct(F.concat(*[places(x["hit"], pattern) for pattern in PARTS]))
        return F.when(x["hit"].rlike("[+/]") & x["hit"].rlike("[_-]"), F.transform(either, shift)).otherwise(F.array(x))

    return F.flatten(F.transform(runs, parts))


def alone(runs: Column, base: Column) -> Column:
    """Those of the runs that share no character with a span of base.

    Both stand in one line by their start. What reaches over a run's start ends the latest of the spans before;
    what begins within it is the next span after."""
    last = F.lit((1 << 31) - 1)
    event = lambda x, run: F.struct(x["start"].alias("start"), x["end"].alias("end"), run.alias("run"))

    def free(line):
        ends = running(F.transform(line, lambda e: F.when(e["run"].isNull(), e["end"]).otherwise(F.lit(0))), F.greatest, "int")
        starts = running(F.reverse(F.transform(line, lambda e: F.when(e["run"].isNull(), e["start"]).otherwise(last))), F.least, "int")
        limits = F.zip_with(ends, F.reverse(starts), lambda a, b: F.struct(a.alias("before"), b.alias("after")))
        both = F.zip_with(line, limits, lambda e, x: F.when((x["before"] <= e["start"]) & (x["after"] >= e["end"]), e["run"]))
        return F.filter(both, lambda x: x.isNotNull())

    def line(runs):
        return F.sort_array(F.concat(F.transform(base, lambda x: event(x, F.lit(None).cast(SPAN))), F.transform(runs, lambda x: event(x, x))))

    return let(runs, lambda rs: F.when((F.size(base) > 0) & (F.size(rs) > 0), let(line(rs), free)).otherwise(rs))


def battery(hit: Column) -> Column:
    """band and bin of a string that may be random; null for others."""
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    neighbours = lambda xs, f: total(F.zip_with(F.slice(xs, F.lit(1), F.size(xs) - 1), F.slice(xs, F.lit(2), F.size(xs) - 1), f))

    def inferred(body):
        return (
            F.when(body.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), F.lit(16))
            .when(body.rlike("^[A-Z2-7]+$"), F.lit(32))
            .when(body.rlike("^(?:[A-Za-z0-9+/]+|[A-Za-z0-9_-]+)$"), F.lit(64))
        )

    def measured(body):
        """Length, sum of squared counts, changes of class and serial correlation."""
        chars = F.filter(F.split(body, ""), lambda c: c != "")

        def of(chars):
            squares = total(F.transform(F.array_distinct(chars), lambda c: F.pow(F.size(F.filter(chars, lambda x: x == c)).cast("double"), F.lit(2.0))))
            kind = F.transform(chars, lambda c: F.when(c.between("a", "z"), 0).when(c.between("A", "Z"), 1).otherwise(2))
            changes = let(kind, lambda ks: neighbours(ks, lambda x, y: F.when(x != y, 1.0).otherwise(0.0)))
            off = let(F.transform(chars, lambda c: F.ascii(c).cast("double")), lambda xs: let(total(xs) / F.size(xs), lambda mean: F.transform(xs, lambda x: x - mean)))
            serial = let(off, lambda xs: neighbours(xs, lambda x, y: x * y) / F.greatest(total(F.transform(xs, lambda x: x * x)), F.lit(1e-9)))
            return F.struct(F.size(chars).cast("double").alias("n"), squares.alias("squares"), changes.alias("changes"), serial.alias("serial"))

        return let(chars, of)

    def judged(symbols, m):
        n, squares, serial = m["n"], m["squares"], m["serial"]
        # two of few digits agree more often than two letters of a word do
        usual = F.when(symbols == 16, F.lit(AGREE_HEX)).otherwise(F.lit(AGREE))
        uniform = (usual - (squares - n) / (n * (n - 1))) / F.sqrt(2 * usual * (1 - usual) / (n * (n - 1)))
        runs = (m["changes"] / (n - 1) - CHANGE) / F.sqrt(F.lit(CHANGE * (1 - CHANGE)) / (n - 1))
        close = (F.lit(SERIAL) - F.abs(serial)) * F.sqrt(n - 1)
        z = (uniform + runs + close) / F.sqrt(F.lit(3.0))
        # -log10 of the normal tail
        tail = let(z, lambda z: F.when(z > 0, (0.717 * z + 0.416 * z * z) / F.log(F.lit(10.0))).otherwise(F.lit(0.0)))
        chi = symbols * squares / n - n
        random = (chi <= symbols - 1 + 4 * F.sqrt(2.0 * (symbols - 1))) & (F.abs(serial) * F.sqrt(n - 1) <= 3.5)
        band = F.size(F.filter(F.array(*[F.lit(b) for b in BANDS]), lambda b: n >= b))
        return F.struct(band.alias("band"), F.when(random, F.least(F.floor(tail * 10), F.lit(BINS))).otherwise(F.lit(0)).cast("int").alias("bin"))

    def tested(body):
        able = mixed & (F.length(body) >= BANDS[0])
        return let(F.when(able, inferred(body)), lambda symbols: F.when(symbols.isNotNull(), let(measured(body), lambda m: judged(symbols, m))))

    mixed = (hit.rlike("[0-9]") & hit.rlike("[A-Za-z]")) | hit.rlike("[a-z][A-Z]")
    return let(F.rtrim(hit, F.lit("=")), tested)


def scan(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (doc_id by default), n_assign, n_access, n_hex, and ``marks``: all spans, an
    array of (start, kind as numbered in KINDS, end, and the first and last byte's place: from, to), ordered."""
    keep = keep or ["doc_id"]
    text = F.coalesce(F.col("text"), F.lit(""))
    first = docs.select(
        F.struct(*keep).alias("row"),
        found(text, ASSIGN, r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]").alias("a"),
        found(text, ACCESS).alias("k"),
        found(text, HEX).alias("h"),
        found(text, RUN).alias("r"),
    )
    first = first.withColumn("a", F.filter("a", lambda x: F.length(F.regexp_extract(x["hit"], ASSIGN, 2)) >= 8))
    bare = lambda name, kind: F.transform(name, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end"), x["from"].alias("from"), x["to"].alias("to")))
    base = F.array_sort(F.concat(bare("a", 0), bare("k", 1), bare("h", 2)))
    first = first.select("row", base.alias("base"), F.size("a").alias("a"), F.size("k").alias("k"), F.size("h").alias("h"), "r")
    first = first.withColumn("r", split_mixed("r")).withColumn("r", alone(F.col("r"), F.col("base")))
    tested = F.transform("r", lambda x: F.struct(*[x[c].alias(c) for c in ("start", "end", "from", "to")], battery(x["hit"]).alias("t")))
    first = first.withColumn("r", F.filter(tested, lambda x: x["t"].isNotNull()))
    first = settle(first)
    table = first.select(F.explode("r").alias("x")).groupBy("x.t.band", "x.t.bin").count()  # len(BANDS) x (BINS + 1) rows at most
    down = Window.partitionBy("band").orderBy(F.col("bin").desc())
    table = table.withColumn("beyond", F.sum("count").over(down)).withColumn("all", F.sum("count").over(Window.partitionBy("band")))
    fair = F.pow(F.lit(10.0), -F.col("bin") / 10) * F.col("all") <= F.lit(FALSE_DISCOVERIES) * F.col("beyond")
    least = table.where(fair & (F.col("bin") > 0)).groupBy("band").agg(F.min("bin").alias("bin"))
    limits = {r["band"]: r["bin"] for r in least.collect()}  # a row for each band at most
    limit = lambda band: F.coalesce(*[F.when(band == b, F.lit(x)) for b, x in limits.items()], F.lit(BINS + 1))
    passed = F.filter("r", lambda x: x["t"]["bin"] >= limit(x["t"]["band"]))
    added = bare(passed, 3)
    return first.select(
        "row.*", *[F.col(c).cast("long").alias(n) for c, n in (("a", "n_assign"), ("k", "n_access"), ("h", "n_hex"))],
        "base", F.array_sort(F.concat("base", added)).alias("marks"),
    )


def shown(marks: str) -> Column:
    """kind:start:end of each mark, comma-joined."""
    name = lambda k: F.element_at(F.array(*[F.lit(x) for x in KINDS]), k + 1)
    return F.array_join(F.transform(marks, lambda x: F.concat_ws(":", name(x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    return scan(docs).select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(shown("base").cast("binary"), 256).alias("base_sha256"), shown("marks").alias("spans"))


def redact(docs: DataFrame, by: str = "[secret]") -> DataFrame:
    """docs with each marked stretch of text replaced; overlapping marks count as one."""
    names = docs.columns
    out = scan(docs, names)
    # marks reach to the furthest end so far; one that starts before that adds nothing of its own
    reach = running(F.transform("marks", lambda x: x["to"]), F.greatest, "int")

    def pieces(raw, reach):
        since = lambda at, to: F.substring(raw, at + 1, to - at).cast("string")

        def piece(x, i):
            at = F.when(i > 0, F.get(reach, i - 1)).otherwise(F.lit(0))
            return F.when(x["from"] >= at, F.concat(since(at, x["from"]), F.lit(by))).otherwise(F.lit(""))

        return F.concat(F.array_join(F.transform("marks", piece), ""), since(F.element_at(reach, -1), F.octet_length(raw)))

    whole = let(F.col("text").cast("binary"), lambda raw: let(reach, lambda r: pieces(raw, r)))
    clean = F.when(F.size("marks") > 0, whole).otherwise(F.col("text"))
    return out.withColumn("text", clean).select(*names)
