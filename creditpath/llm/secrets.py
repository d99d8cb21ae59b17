"""Secret scans: fixed patterns, and a battery of randomness tests with false-discovery control.

Tokens that could be keys are read in the encoding that their characters suggest. Three
tests measure how far the symbols are from uniform and independent: chi-squared over
equal parts of the alphabet, runs above and below its middle, and the correlation of
neighbours. Their p-values are combined; within each class of token length, randomness
is rejected for tokens under control of the false-discovery rate over the whole corpus.
Tokens that are not rejected are taken for secrets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditpath.llm.common import sha256_hex

# Fixed patterns. Groups: 1 the name, 2 the value.
ASSIGN = (
    r"((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]"
    r"|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS, HEX = r"AKIA[A-Z0-9]{14,}", r"[0-9a-f]{16,}"
MIN_VALUE = 12
KINDS = ("assign", "access", "hex", "random")

# Shortest token for which the tests have power, and the share of falsely rejected random tokens.
MIN_TOKEN, FALSE_DISCOVERY = 20, 0.05
TOKEN = rf"[A-Za-z0-9+/_-]{{{MIN_TOKEN},}}"
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Encodings in the order in which they are tried; the first whose alphabet has every character is inferred.
ENCODINGS = (
    ("[0-9a-f]+", _DIGITS + "abcdef"),
    ("[0-9A-F]+", _DIGITS + "ABCDEF"),
    ("[A-Z2-7]+", _UPPER + "234567"),
    ("[0-9a-z]+", _DIGITS + _LOWER),
    ("[0-9A-Z]+", _DIGITS + _UPPER),
    ("[A-Za-z0-9+/]+", _UPPER + _LOWER + _DIGITS + "+/"),
    ("[A-Za-z0-9_-]+", _UPPER + _LOWER + _DIGITS + "-_"),
    ("[A-Za-z0-9+/_-]+", _UPPER + _LOWER + _DIGITS + "+/-_"),
)
CELLS = 5
# Steps of the p-value's negative decimal logarithm in which tokens are counted, and the largest step.
STEPS, MAX_STEP = 20, 400
# Entries of an array that grow by copying, and code points of the chunks a text is cut into for masking.
BLOCK, CHUNK = 64, 4096


def _named(value: Column, use) -> Column:
    """``use`` of a value that is computed once: inside of a lambda, a variable stands for it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _running(values: Column, start: Column, step, levels: int = 3) -> Column:
    """For each of ``values`` what ``step`` has made of ``start`` and the values before it; integers.

    Arrays are copied as they grow, so they grow within blocks of ``BLOCK`` values, and what a block
    begins with comes from the same sums over whole blocks: the work is linear up to ``BLOCK ** levels`` values.
    """
    none = F.expr("array()").cast("array<int>")

    def within(part: Column, first: Column) -> Column:
        return F.aggregate(
            part,
            F.struct(first.alias("now"), none.alias("seen")),
            lambda s, v: F.struct(step(s["now"], v).alias("now"), F.concat(s["seen"], F.array(s["now"])).alias("seen")),
            lambda s: s["seen"],
        )

    if levels == 1:
        return within(values, start)

    def in_blocks(v: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.greatest(F.size(v), F.lit(1)) - 1) / F.lit(BLOCK)).cast("int"))
        return _named(F.transform(numbers, lambda b: F.slice(v, b * BLOCK + 1, BLOCK)), from_blocks)

    def from_blocks(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda part: F.aggregate(part, start, step))
        return F.flatten(F.zip_with(blocks, _running(totals, start, step, levels - 1), within))

    return _named(values, in_blocks)


def _matches(text: Column, pattern: str) -> Column:
    """(start, end, text) of the leftmost non-overlapping matches of ``pattern``, in code points."""
    none = F.expr("array()").cast("array<struct<start:int,end:int,text:string>>")
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern), lambda g: F.length(g))

    def placed(t: Column) -> Column:
        # Before a match: the gaps up to it and the matches before it.
        steps = F.zip_with(F.slice(t["gaps"], 1, F.size(t["hits"])), t["hits"], lambda g, h: g + F.length(h))
        ends = F.zip_with(_running(steps, F.lit(0), lambda a, b: a + b), steps, lambda a, b: a + b)
        return F.zip_with(
            ends, t["hits"], lambda e, h: F.struct((e - F.length(h)).alias("start"), e.alias("end"), h.alias("text"))
        )

    found = _named(F.struct(gaps.alias("gaps"), hits.alias("hits")), placed)
    return F.when(F.rlike(text, F.lit(pattern)), found).otherwise(none)


def _union(spans: Column) -> Column:
    """(start, end) of the stretches that the (start, end) of ``spans`` cover, in order; spans that meet are one."""

    def merged(t: Column) -> Column:
        before = _running(F.transform(t, lambda s: s["end"]), F.lit(-1), lambda a, b: F.greatest(a, b))
        return _named(F.zip_with(t, before, lambda s, b: F.struct(s["start"].alias("start"), b.alias("before"))), closed(t))

    def closed(t: Column):
        last = F.array(F.array_max(F.transform(t, lambda s: s["end"])))

        def ends(marked: Column) -> Column:
            firsts = F.filter(marked, lambda m: m["start"] > m["before"])
            # A stretch ends with the furthest end before the next one's start.
            stops = F.concat(F.transform(F.slice(firsts, 2, F.greatest(F.size(firsts) - 1, F.lit(0))), lambda m: m["before"]), last)
            return F.zip_with(firsts, stops, lambda m, e: F.struct(m["start"].alias("start"), e.alias("end")))

        return ends

    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    none = F.expr("array()").cast("array<struct<start:int,end:int>>")
    return F.when(F.size(spans) > 0, _named(ordered, merged)).otherwise(none)


def _how_many(sorted_values: Column, holds) -> Column:
    """How many entries at the front of a sorted array ``holds`` is true for, by bisection."""
    return F.aggregate(
        F.array(*[F.lit(1 << b) for b in range(29, -1, -1)]),
        F.lit(0),
        lambda at, step: F.when(
            (at + step <= F.size(sorted_values)) & holds(F.get(sorted_values, at + step - 1)), at + step
        ).otherwise(at),
    )


def _uncovered(token: Column, covered: Column) -> Column:
    """The parts of a token (start, end) outside of the ``covered`` stretches."""

    def parts(met: Column) -> Column:
        starts = F.concat(F.array(token["start"]), F.transform(met, lambda s: s["end"]))
        ends = F.concat(F.transform(met, lambda s: s["start"]), F.array(token["end"]))
        rest = F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("start"), F.lit(3).alias("kind"), b.alias("end")))
        return F.filter(rest, lambda r: r["start"] < r["end"])

    first = _how_many(covered, lambda s: s["end"] <= token["start"])
    return _named(first, lambda lo: _named(
        F.slice(covered, lo + 1, F.greatest(_how_many(covered, lambda s: s["start"] < token["end"]) - lo, F.lit(0))), parts
    ))


def _normal_tails(z: Column) -> Column:
    """Both tails of the normal distribution, by a logistic curve (off by less than 0.0003)."""
    z = F.abs(z)
    return F.lit(2.0) / (F.lit(1.0) + F.exp(F.lit(1.5976) * z + F.lit(0.07056) * z * z * z))


def _randomness(token: Column) -> Column:
    """The p-value of a token's symbols being uniform and independent."""
    alphabet = F.lit("")
    for pattern, letters in reversed(ENCODINGS):
        fits = F.rlike(token, F.lit(f"^{pattern}$"))
        alphabet = F.when(fits, F.lit(letters)).otherwise(alphabet)
    # A one-entry array names an intermediate value inside the expression.
    named = F.array(F.struct(token.alias("token"), alphabet.alias("alphabet")))

    def with_values(t: Column) -> Column:
        values = F.transform(F.split(t["token"], ""), lambda c: F.instr(t["alphabet"], c) - 1)
        return F.struct(F.length(t["alphabet"]).alias("k"), values.alias("v"))

    def tested(t: Column) -> Column:
        k, v = t["k"], t["v"]
        n = F.size(v).cast("double")
        chi = F.aggregate(
            F.sequence(F.lit(0), F.lit(CELLS - 1)),
            F.lit(0.0),
            lambda seen, cell: seen + _squared(
                F.size(F.filter(v, lambda x: F.floor(x * CELLS / k) == cell)),
                n * (F.ceil((cell + 1) * k / F.lit(CELLS)) - F.ceil(cell * k / F.lit(CELLS))) / k,
            ),
        )
        ahead = F.slice(v, 2, F.size(v) - 1)
        behind = F.slice(v, 1, F.size(v) - 1)
        turns = F.zip_with(behind, ahead, lambda a, b: F.when((2 * a >= k) != (2 * b >= k), 1).otherwise(0))
        runs = 1 + F.aggregate(turns, F.lit(0), lambda seen, x: seen + x)
        z_runs = (runs - (F.lit(1.0) + (n - 1) / 2)) / F.sqrt((n - 1) / 4)
        middle = (k - 1) / F.lit(2.0)
        products = F.zip_with(behind, ahead, lambda a, b: (a - middle) * (b - middle))
        covered = F.aggregate(products, F.lit(0.0), lambda seen, x: seen + x)
        z_next = covered / ((F.lit(1.0) * k * k - 1) / 12) / F.sqrt(n - 1)
        return F.struct(chi.alias("chi"), z_runs.alias("z_runs"), z_next.alias("z_next"))

    def combined(t: Column) -> Column:
        half = t["chi"] / 2
        tiny = F.lit(1e-300)
        logs = (
            F.ln(F.greatest(F.exp(-half) * (1 + half), tiny))
            + F.ln(F.greatest(_normal_tails(t["z_runs"]), tiny))
            + F.ln(F.greatest(_normal_tails(t["z_next"]), tiny))
        )
        return -logs

    sums = F.transform(F.transform(F.transform(named, with_values), tested), combined)
    # Fisher: twice the sum has a chi-squared distribution of six degrees of freedom.
    tails = F.transform(sums, lambda x: F.exp(-x) * (1 + x + x * x / 2))
    return F.get(tails, F.lit(0))


def _squared(seen: Column, expected: Column) -> Column:
    return (seen - expected) * (seen - expected) / expected


def _candidates(text: Column) -> Column:
    """The tokens with a digit and a letter: (start, end, class of length, step of the p-value)."""
    found = _matches(text, TOKEN)
    found = F.filter(found, lambda m: F.rlike(m["text"], F.lit("[0-9]")) & F.rlike(m["text"], F.lit("[A-Za-z]")))
    tested = F.transform(found, lambda m: F.struct(m["start"], m["end"], _randomness(m["text"]).alias("p")))
    step = lambda p: F.least(F.floor(-F.log10(F.greatest(p, F.lit(1e-300))) * STEPS), F.lit(MAX_STEP)).cast("int")
    return F.transform(
        tested,
        lambda m: F.struct(
            m["start"].alias("start"),
            m["end"].alias("end"),
            F.least(F.floor(F.log2(m["end"] - m["start"])), F.lit(30)).cast("int").alias("class"),
            step(m["p"]).alias("step"),
        ),
    )


def rejected_from(documents: DataFrame, false_discovery: float = FALSE_DISCOVERY) -> dict[int, int]:
    """For each class of length the smallest step of p-values at which randomness is rejected.

    Benjamini and Hochberg's procedure over all tokens of the corpus. A step counts with
    the largest p-value it holds, so the rate is not exceeded. There are at most 31 classes
    of ``MAX_STEP + 1`` steps, whatever the corpus; their counts come to the driver.
    """
    each = documents.select(F.explode(_candidates(F.coalesce("text", F.lit("")))).alias("c"))
    counts = each.groupBy("c.class", "c.step").agg(F.count(F.lit(1)).alias("n")).collect()
    steps: dict[int, dict[int, int]] = {}
    for row in counts:
        steps.setdefault(row["class"], {})[row["step"]] = row["n"]
    result = {}
    for size, seen in steps.items():
        total, before = sum(seen.values()), 0
        for step in sorted(seen, reverse=True):
            before += seen[step]
            if 10 ** (-step / STEPS) <= false_discovery * before / total:
                result[size] = step
    return result


def secrets(documents: DataFrame, false_discovery: float = FALSE_DISCOVERY) -> DataFrame:
    """``documents`` (text and any further columns) with ``secrets``: (start, kind, end) in order.

    kind is the place in ``KINDS``; start and end count code points, end exclusive.
    Matches of the fixed patterns all stay; of a random token the parts that they do not
    cover are added. A NULL text is empty; repeated rows are returned as often; a corpus
    without tokens rejects none. A column named ``secrets`` is replaced; columns named
    ``_assign``, ``_access``, ``_hex``, ``_tokens`` or ``_base`` are dropped.
    """
    limits = rejected_from(documents, false_discovery)
    text = F.coalesce(F.col("text"), F.lit(""))
    value = lambda m: F.length(F.regexp_extract(m["text"], ASSIGN, 2)) >= MIN_VALUE
    fixed = documents.withColumns(
        {
            "_assign": F.filter(_matches(text, ASSIGN), value),
            "_access": _matches(text, ACCESS),
            "_hex": _matches(text, HEX),
            "_tokens": _candidates(text),
        }
    )
    spans = lambda name, kind: F.transform(
        name, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end"))
    )
    fixed = fixed.withColumn("_base", F.concat(spans("_assign", 0), spans("_access", 1), spans("_hex", 2)))

    def is_random(c: Column) -> Column:
        below = F.lit(True)
        for size, step in sorted(limits.items()):
            below = below & ((c["class"] != size) | (c["step"] < step))
        return below

    fixed = fixed.withColumn("_tokens", F.filter("_tokens", is_random))
    rest = lambda covered: F.flatten(F.transform("_tokens", lambda c: _uncovered(c, covered)))
    none = F.expr("array()").cast("array<struct<start:int,kind:int,end:int>>")
    added = F.when(F.size("_tokens") > 0, _named(_union(F.col("_base")), rest)).otherwise(none)
    return fixed.withColumn("secrets", F.array_sort(F.concat("_base", added))).drop(
        "_assign", "_access", "_hex", "_tokens", "_base"
    )


def masked(documents: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``documents`` with every span of ``secrets`` in ``text`` replaced by ``mark``; spans that meet are one."""

    def of_chunks(chunks: Column):
        def piece(start: Column, end: Column) -> Column:
            """The text from start to end; only the chunks that it reaches into are looked at."""
            last = F.floor((F.greatest(end - 1, start)) / F.lit(CHUNK)).cast("int")
            numbers = F.sequence(F.floor(start / F.lit(CHUNK)).cast("int"), last)
            within = lambda c: F.substr(
                F.get(chunks, c),
                F.greatest(start - c * CHUNK, F.lit(0)) + 1,
                F.least(end - c * CHUNK, F.lit(CHUNK)) - F.greatest(start - c * CHUNK, F.lit(0)),
            )
            return F.when(start < end, F.array_join(F.transform(numbers, within), "")).otherwise("")

        def pieces(covered: Column) -> Column:
            starts = F.concat(F.array(F.lit(0)), F.transform(covered, lambda s: s["end"]))
            ends = F.concat(F.transform(covered, lambda s: s["start"]), F.array(F.length("text")))
            return F.array_join(F.zip_with(starts, ends, piece), mark)

        return _named(_union(F.col("secrets")), pieces)

    chunks = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    return documents.withColumn(
        "text", F.when(F.size("secrets") > 0, _named(chunks, of_chunks)).otherwise(F.col("text"))
    )


def secret_digest(documents: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    found = secrets(documents.select("doc_id", "text"))
    names = F.array(*[F.lit(k) for k in KINDS])
    told = lambda spans: F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )
    number = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        number(0).alias("n_assign"),
        number(1).alias("n_access"),
        number(2).alias("n_hex"),
        sha256_hex(told(F.filter("secrets", lambda s: s["kind"] < 3))).alias("base_sha256"),
        told(F.col("secrets")).alias("spans"),
    )
