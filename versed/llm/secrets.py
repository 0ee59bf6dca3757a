"""Secret scans: fixed patterns, and two character Markov models compared by log-likelihood ratio.

One model describes random strings, the other ordinary identifiers and words. Both are first-order chains over printable
ASCII, counted with DataFrame operations from labelled samples (SAMPLES or another table of that size). A run of token
characters is a secret when the ratio of its likelihoods, per transition and in total, passes two bounds. Scoring and
span arithmetic are SQL expressions over one scan of the documents, without a shuffle.

Spans are counted in code points, end exclusive. Regular expressions give the matches and the text between them, and
running sums of the lengths of both give the positions. Sums, searches and replacements take time in proportion to the
number of matches, but for a logarithm.

Defined cases: a null text counts as empty and has no spans; whole texts are scanned; of spans that start together the
kind listed first comes first; a token run that touches a span of a fixed pattern is no span of its own; repeated rows
give repeated results; an empty table gives an empty result; other input columns are ignored by scan() and kept by
redact(), whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from versed.llm.common import whole_row, whole_text

#: Kinds in the order in which they are listed.
KINDS = ("assign", "access", "hex", "markov")

#: Fixed patterns; case is spelled out so that only ASCII letters count.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Runs that the models judge.
RUN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"

#: A run is a secret from these log-likelihood ratios on: per transition, and in total (nats).
PER_CHARACTER, IN_ALL = 0.35, 9.0

#: Words that make up the labelled ordinary identifiers.
WORDS = """
user name account password secret token key value index count total number file path folder server client request response
error message table column row field record session cache buffer stream thread process queue event handler listener
manager factory service module package version config setting option default result status state node tree graph list
array string integer float boolean object class method function parameter argument return create update delete insert
select filter group order limit offset page query search find get set add remove open close read write load save start stop
the and that this with from have which would there their about could people these after other those where because through
der die das und nicht eine einer werden wurde haben durch schaft lichkeit ungen zwischen
les des une dans pour avec cette sont mais nous vous entre ation ement quelque
los las una para como pero esta todo cuando sobre mente ciones adores entre
""".split()


def samples(spark: SparkSession) -> DataFrame:
    """Labelled samples (text, random): hashes in base 16 and 64 stand for random strings, joined words for identifiers."""
    digest = F.sha2(F.col("id").cast("string").cast("binary"), 256)
    random = spark.range(1500).select(F.explode(F.array(
        F.substring(digest, 1, 40), F.upper(F.substring(digest, 9, 32)), F.substring(F.base64(F.unhex(digest)), 1, 40),
        F.substring(F.translate(F.base64(F.unhex(F.sha2(F.concat(digest, F.lit("a")).cast("binary"), 256))), "+/=", "-_"), 1, 40),
        F.upper(F.substring(F.translate(F.base64(F.unhex(F.sha2(F.concat(digest, F.lit("b")).cast("binary"), 256))), "+/=", ""), 1, 30)),
    )).alias("text")).withColumn("random", F.lit(1))
    words = F.array(*(F.lit(w) for w in WORDS))

    def pick(salt: str) -> Column:
        return F.element_at(words, (F.pmod(F.xxhash64(F.col("id"), F.lit(salt)), F.lit(len(WORDS))) + 1).cast("int"))

    a, b, c, year = pick("a"), pick("b"), pick("c"), (F.pmod(F.xxhash64("id"), F.lit(60)) + 1970).cast("string")
    ordinary = spark.range(3000).select(F.explode(F.array(
        F.concat_ws("_", a, b, c), F.concat_ws("-", b, a, c), F.upper(F.concat_ws("_", a, b, c)), F.concat(a, F.initcap(b), F.initcap(c)),
        F.concat(F.initcap(a), F.initcap(b), F.initcap(c)), F.concat(a, b, c), F.upper(F.concat(b, c, a)), F.concat_ws("/", a, b, c),
        F.concat_ws("-", a, year, b), F.concat_ws("/", year, F.lit("03"), a, b), F.concat_ws("_", a, F.lit("v2"), b),
    )).alias("text")).withColumn("random", F.lit(0))
    return random.unionByName(ordinary)


def train(labelled: DataFrame) -> list[float]:
    """Log-likelihood ratio (random over ordinary) of each transition, at 128 x first + second code: a table of fixed size, 16,384 numbers."""
    pairs = labelled.where(F.col("text").isNotNull()).select("random", F.split("text", "").alias("c")).select(
        "random", F.explode(F.transform(F.slice(F.col("c"), 1, F.greatest(F.size("c") - 1, F.lit(0))), lambda x, i: F.struct(F.ascii(x).alias("a"), F.ascii(F.get(F.col("c"), i + 1)).alias("b")))).alias("p")
    ).select("random", "p.a", "p.b").where("a between 33 and 126 and b between 33 and 126")
    counts = pairs.groupBy("random", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    n = {(r["random"], r["a"], r["b"]): r["n"] for r in counts.collect()}  # at most 2 x 94 x 94 rows
    alphabet = [ord(x) for x in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"]
    out = [0.0] * (128 * 128)
    import math

    for a in alphabet:
        row = {y: sum(n.get((y, a, b), 0) for b in alphabet) for y in (0, 1)}
        for b in alphabet:
            p = {y: (n.get((y, a, b), 0) + 0.5) / (row[y] + 0.5 * len(alphabet)) for y in (0, 1)}
            out[128 * a + b] = math.log(p[1] / p[0])
    return out


def ratio(run: Column, table: Column) -> Column:
    """Sum of the ratios of a run's transitions; the run has token characters only."""
    codes = F.transform(F.split(run, ""), F.ascii)
    step = lambda s, c: F.struct(c.alias("last"), (s["sum"] + F.when(s["last"] < 0, 0.0).otherwise(F.get(table, s["last"] * 128 + c))).alias("sum"))
    return F.aggregate(codes, F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum")), step, lambda s: s["sum"])


SPAN = "array<struct<start:int,kind:int,end:int,text:string>>"
#: Characters of the blocks from which pieces of a text are taken.
BLOCK = 4096


def let(x: Column, f) -> Column:
    """f of x, which is worked out once."""
    return F.element_at(F.transform(F.array(x), f), 1)


def running(numbers: Column, together) -> Column:
    """What `together` (an associative function) makes of each number and all before it, by doubling steps."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(numbers), F.lit(1)))).cast("int"))

    def step(so_far: Column, k: Column) -> Column:
        back = F.pow(F.lit(2), k).cast("int")
        return F.transform(so_far, lambda x, i: F.when(i >= back, together(x, F.get(so_far, i - back))).otherwise(x))

    return F.aggregate(steps, numbers, step)


def before(sorted_: Column, x: Column) -> Column:
    """How many of the sorted numbers are less than x, by bisection."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2((F.size(sorted_) + 1).cast("double"))).cast("int"))

    def step(s: Column, _: Column) -> Column:
        middle = ((s["low"] + s["high"]) / 2).cast("int")
        less, done = F.get(sorted_, middle) < x, s["low"] >= s["high"]
        return F.struct(F.when(done | ~less, s["low"]).otherwise(middle + 1).alias("low"), F.when(done | less, s["high"]).otherwise(middle).alias("high"))

    return F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.size(sorted_).alias("high")), step, lambda s: s["low"])


def positions(text: Column, pattern: str, hits: Column, kind: int) -> Column:
    """The spans of a pattern's matches (`hits`) in the text, from the lengths of matches and of the pieces between."""
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    ends = let(F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: g + F.length(h)), lambda n: running(n, lambda x, y: x + y))
    spans = F.zip_with(hits, ends, lambda h, e: F.struct((e - F.length(h)).alias("start"), F.lit(kind).alias("kind"), e.alias("end"), h.alias("text")))
    return F.when(F.size(hits) == 0, F.array().cast(SPAN)).otherwise(spans.cast(SPAN))


def scanned(rows: DataFrame, table: list[float]) -> DataFrame:
    """`rows` (row, text) with arrays of spans: base of the fixed patterns, more of the models."""
    learned = F.split(F.lit(" ".join(map(repr, table))), " ").cast("array<double>")
    patterns = (ASSIGN, ACCESS, HEX, RUN)
    rows = rows.withColumns({f"h{k}": F.regexp_extract_all("text", F.lit(p), F.lit(0)) for k, p in enumerate(patterns)})
    rows = rows.withColumns({f"s{k}": positions(F.col("text"), p, F.col(f"h{k}"), k) for k, p in enumerate(patterns)})
    assign = F.filter("s0", lambda s: F.length(F.regexp_extract(s["text"], ASSIGN, 2)) >= 6)
    rows = rows.withColumn("base", F.array_sort(F.concat(assign, "s1", "s2")))

    def apart(s: Column, starts: Column, reach: Column) -> Column:
        """No span of a fixed pattern that starts before the run's end ends after its start."""
        return (F.size(starts) == 0) | let(before(starts, s["end"]), lambda n: (n == 0) | (F.get(reach, n - 1) <= s["start"]))

    def secret(s: Column, starts: Column, reach: Column) -> Column:
        return s["text"].rlike("[A-Za-z]") & apart(s, starts, reach) & (ratio(s["text"], learned) >= F.greatest(F.lit(IN_ALL), PER_CHARACTER * (F.length(s["text"]) - 1)))

    # reach: the greatest end so far; bound by let, since a column that a lambda uses could be worked out for each element
    found = let(F.col("base.start"), lambda starts: let(running(F.col("base.end"), F.greatest), lambda reach: F.filter("s3", lambda s: secret(s, starts, reach))))
    return rows.withColumn("more", F.when(F.size("s3") == 0, F.col("s3")).otherwise(found)).select("row", "text", "base", "more")


def joined(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, table: list[float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id_col` and spans: array of (start, kind, end, text) in order, base and model spans together; and base, those of the fixed patterns alone."""
    rows = scanned(docs.select(F.col(id_col).alias("row"), whole_text(text_col).alias("text")), table)
    return rows.select(F.col("row").alias(id_col), "base", F.array_sort(F.concat("base", "more")).alias("spans"))


def masked(text: Column, spans: Column, mask: str) -> Column:
    """The text with `mask` in place of the spans, which are sorted; those that overlap are one."""

    def of(reach: Column, blocks: Column) -> Column:
        def piece(start: Column, end: Column) -> Column:
            a, b = F.floor(start / BLOCK).cast("int"), F.floor(end / BLOCK).cast("int")
            first = F.substring(F.coalesce(F.get(blocks, a), F.lit("")), start % BLOCK + 1, F.when(a == b, end - start).otherwise(BLOCK))
            rest = F.concat(F.array_join(F.slice(blocks, a + 2, F.greatest(b - a - 1, F.lit(0))), ""), F.substring(F.coalesce(F.get(blocks, b), F.lit("")), F.lit(1), end % BLOCK))
            return F.when(a == b, first).otherwise(F.concat(first, rest))

        def at(s: Column, i: Column) -> Column:
            """The text between the spans before and this one, and the mask; nothing if it overlaps one of them."""
            done = F.when(i == 0, 0).otherwise(F.get(reach, i - 1))
            return F.when(s["start"] >= done, F.concat(piece(done, s["start"]), F.lit(mask))).otherwise("")

        return F.concat(F.array_join(F.transform(spans, at), ""), piece(F.element_at(reach, -1), F.length(text)))

    reach = running(F.transform(spans, lambda s: s["end"]), F.greatest)
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    return F.when(F.size(spans) == 0, text).otherwise(let(reach, lambda r: let(blocks, lambda b: of(r, b))))


def redact(docs: DataFrame, table: list[float], mask: str = "[SECRET]", text_col: str = "text") -> DataFrame:
    """All columns of `docs`, with every span of the text replaced by `mask`; spans that overlap are one. A null text stays null."""
    rows = scanned(docs.select(whole_row(docs), whole_text(text_col).alias("text")), table)
    rows = rows.withColumn("spans", F.array_sort(F.concat("base", "more")))
    text = F.when(F.col("row").getField(text_col).isNotNull(), masked(F.col("text"), F.col("spans"), mask))
    return rows.select(*(text.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns))
