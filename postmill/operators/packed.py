"""Several values packed in one field -> one row per value with its position.

The delimiter is inferred per source from the data. A source is a field together with a layout: the set of
delimiter candidates that occur in the value outside quotes, brackets and parentheses, each marked with whether
its pieces are of one type. For every source all subsets of its candidates are scored over all its rows:

* piece-type regularity: share of pieces of a known type - a value that stands alone elsewhere in the field, a
  quoted piece, or a full address;
* piece-count consistency: 1 / (1 + relative deviation of the number of pieces).

The best subset splits the values. The table of decisions is bounded by the number of candidate sets, never by
the data. Weak delimiters (those that also occur inside names, as in "CI/CD") never split a piece that is itself a
known value.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from postmill.session import broadcast_if_small, checkpointed

#: Delimiter candidates. A hyphen between digits is a range; a tight slash is another candidate than a spaced one.
STRONG = {
    "newline": r"\s*[\r\n]+\s*",
    "semicolon": r"\s*;\s*",
    "bar": r"\s*\|\s*",
    "bullet": r"\s*[•●▪]\s*",
    "ideographic": r"\s*[、，；]\s*",
    "comma": r"\s*,\s*",
}
WEAK = {
    "slash_spaced": r"\s+/\s+",
    "slash_tight": r"(?<=\S)/(?=\S)",
    "dash_spaced": r"(?:(?<!\d)\s+[-–—](?:\s+[-–—])*(?:\s+|$)|\s+[-–—](?:\s+[-–—])*\s+(?!\d))",
    "ampersand": r"\s+&\s+",
    "conjunction": r"\s+(?:và|and)\s+",
}
CANDIDATES = STRONG | WEAK
#: Times a value must stand alone to be known.
MIN_SUPPORT = 2
#: Tables up to this size are broadcast, larger ones joined by shuffle.
MAX_BROADCAST_ROWS = 20_000

_PLAIN = ",;|/•●▪、，；&\n\r-–— "
_MARKS = "".join(chr(0xE000 + i) for i in range(len(_PLAIN)))
_CUT = chr(0xE100)
QUOTED = r"""(?:^|[,;|/•、，\n&–—-]\s*|\s)(?:"[^"]*"|'[^']*')\s*(?:$|[,;|/•、，\n&–—-]|\s)"""
_AFTER = r"(?=\s*(?:$|[,;|/•、，\n&–—-]|và\s|and\s))"
_BEFORE = r"(?<=^|[,;|/•、，\n&–—-]|\svà|\sand)"


def protect(text: Column) -> Column:
    """Hide delimiters inside "...", '...' and (...) behind marks; an enclosing list bracket is removed.

    A quote opens at the start or after a delimiter and closes before one or at the end, so an apostrophe
    inside a word protects nothing.
    """
    t = F.regexp_replace(F.trim(text), r"(?s)^\[(.*)\]\s*$", "$1")
    hidden = rf"""(?s)({_BEFORE}\s*"[^"]*"{_AFTER}|{_BEFORE}\s*'[^']*'{_AFTER}|\([^()]*\))"""
    pieces = F.split(F.regexp_replace(t, hidden, f"{_CUT}$1{_CUT}"), _CUT, -1)
    return F.array_join(F.transform(pieces, lambda x, i: F.when(i % 2 == 1, F.translate(F.trim(x), _PLAIN, _MARKS)).otherwise(x)), "")


_BLANKS = " \t\n\r\f\u000b\u00a0\u3000"


def _trim(text: Column) -> Column:
    return F.btrim(text, F.lit(_BLANKS))


def _blank(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\n\r\f\u000b")) == ""


def restore(piece: Column) -> Column:
    """The written value of a piece: marks undone, blanks, enclosing quotes and brackets trimmed."""
    # each step names the text once: lambdas share no subexpressions, and a text named twice per step would be computed 2^steps times
    t = _trim(F.translate(piece, _MARKS, _PLAIN))
    t = _trim(F.regexp_replace(t, r"""(?s)^"([^"]*)"$|^'([^']*)'$""", "$1$2"))
    return _trim(F.regexp_replace(t, r"(?s)^\[([^\[\]]*)\]$", "$1"))


def value_key(piece: Column) -> Column:
    """What a value is known by: lower case, without a remark in parentheses at its end."""
    return F.lower(_trim(F.regexp_replace(restore(piece), r"\s*\([^()]*\)$", "")))


#: Words of addresses. Fixed vocabulary.
STREET = r"(?iU)\b(st|street|blvd|road|rd|ave|avenue|đường|(?<!b[iì]nh )duong(?=\s+\w)|đại lộ|dai lo|floor|tầng|tòa nhà|toà nhà|building|tower|plaza|house|block|hub|center|centre)\b"
WARD = r"(?iU)\b(ward|district|quận|quan|phường|phuong|huyện|xã|commune)\b"


def piece_type(piece: Column) -> Column:
    """'street', 'ward' or 'name', by the words of the piece."""
    return F.when(piece.rlike(STREET), F.lit("street")).when(piece.rlike(WARD), F.lit("ward")).otherwise(F.lit("name"))


def _is_address(piece: Column) -> Column:
    last = F.substring_index(piece, ",", -1)
    other = "|".join(f"(?:{p})" for n, p in CANDIDATES.items() if n != "comma")
    return piece.contains(",") & ~last.rlike(r"\d") & piece.rlike(STREET + "|" + WARD) & (piece_type(last) == "name") & ~piece.rlike(other)


def _is_quoted(piece: Column) -> Column:
    return piece.rlike(r"""^\s*("[^"]*"|'[^']*')\s*$""")


def _pieces(protected: Column, pattern: str | Column) -> Column:
    """Non-blank pieces in order."""
    return F.filter(F.split(protected, pattern, -1), lambda x: ~_blank(x))


def _layout(protected: Column) -> Column:
    """Candidates that occur in the value, each with '=' if all its pieces are of one type, else '~'; "quoted!" if it has a quoted piece."""
    marks = []
    for name, pattern in CANDIDATES.items():
        kinds = F.array_distinct(F.transform(_pieces(protected, pattern), piece_type))
        marks.append(F.when(protected.rlike(pattern), F.when(F.size(kinds) <= 1, F.lit(f"{name}=")).otherwise(F.lit(f"{name}~"))))
    quotes = protected.contains('"') | protected.contains("'")
    marks.append(F.when(quotes, F.when(protected.rlike(QUOTED), F.lit("quoted!"))))
    return F.concat_ws(" ", *marks)


def _union(names: tuple[str, ...] | list[str]) -> str:
    """One pattern for several delimiters, longer ones first; runs of delimiters count as one."""
    order = [n for n in (*WEAK, *STRONG) if n in names]
    return "|".join(f"(?:{CANDIDATES[n]})" for n in order)


def _subsets(layout: str) -> list[tuple[str, ...]]:
    names = [x[:-1] for x in layout.split() if x != "quoted!"]
    return [c for k in range(len(names) + 1) for c in combinations(names, k)]


def _known(pieces: DataFrame) -> DataFrame:
    """(source, key): values known to stand alone, from rows (source, piece)."""
    return pieces.groupBy("source", value_key(F.col("piece")).alias("key")).count().filter((F.col("count") >= MIN_SUPPORT) & (F.col("key") != "")).select("source", "key")


def _decide(values: DataFrame, known: DataFrame) -> DataFrame:
    """(source, layout, pattern_strong, pattern_weak): the best-scored delimiter set of every source and layout.

    `values`: source, layout, protected, n (rows with this text). The layouts that occur are read to the
    driver: their number is bounded by the candidate sets (at most 3^11, in practice dozens), not by the rows.
    """
    spark = values.sparkSession
    layouts = [r[0] for r in values.select("layout").distinct().collect()]
    rows = [(lay, ",".join(s), _union(s), _union([x for x in s if x in STRONG]), _union([x for x in s if x in WEAK])) for lay in layouts for s in _subsets(lay)]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("layout", "subset", "pattern", "strong", "weak")])
    options = spark.createDataFrame(rows, schema)
    whole = F.when(F.col("pattern") == "", F.array("protected")).otherwise(_pieces(F.col("protected"), F.col("pattern")))
    tried = values.join(broadcast_if_small(options, MAX_BROADCAST_ROWS), "layout").select("source", "layout", "subset", "n", whole.alias("pieces"))
    # the numbers of pieces travel with the first piece, so that the texts are split once
    each = tried.select("source", "layout", "subset", "n", F.size("pieces").cast("double").alias("size"), F.posexplode("pieces").alias("at", "piece"))
    first = F.when(F.col("at") == 0, F.col("n")).otherwise(0)
    # equal pieces are counted before their keys are found: most stand in many texts and subsets
    raw = each.groupBy("source", "layout", "subset", "piece").agg(F.sum("n").alias("n"), F.sum(first).alias("rows"), F.sum(first * F.col("size")).alias("sizes"), F.sum(first * F.col("size") * F.col("size")).alias("squares"))
    keyed = raw.withColumn("key", F.when(_is_quoted(F.col("piece")) | _is_address(F.col("piece")), F.lit(None)).otherwise(value_key(F.col("piece"))))
    marked = keyed.groupBy("source", "layout", "subset", "key").agg(*(F.sum(c).alias(c) for c in ("n", "rows", "sizes", "squares")))
    fits = F.col("key").isNull() | F.col("known")
    scored = (
        marked.join(known.withColumn("known", F.lit(True)), ["source", "key"], "left")
        .groupBy("source", "layout", "subset")
        .agg((F.sum(F.when(fits, F.col("n")).otherwise(0)) / F.sum("n")).alias("regularity"), (F.sum("sizes") / F.sum("rows")).alias("mean"), (F.sum("squares") / F.sum("rows")).alias("square"))
    )
    deviation = F.sqrt(F.greatest(F.lit(0.0), F.col("square") - F.col("mean") * F.col("mean"))) / F.col("mean")
    scored = scored.withColumn("score", F.col("regularity") * (0.9 + 0.1 / (1 + deviation)))
    best = scored.groupBy("source", "layout").agg(F.max_by("subset", F.struct("score", F.size(F.split("subset", ",")), "subset")).alias("subset"))
    return best.join(broadcast_if_small(options, MAX_BROADCAST_ROWS), ["layout", "subset"]).select("source", "layout", "subset", "strong", "weak")


def _split(values: DataFrame, decisions: DataFrame) -> DataFrame:
    """`values` with the pieces of the strong split and the weak pattern ('' = none)."""
    out = values.join(broadcast_if_small(decisions, MAX_BROADCAST_ROWS), ["source", "layout"])
    return out.withColumn("pieces", F.when(F.col("strong") == "", F.array("protected")).otherwise(_pieces(F.col("protected"), F.col("strong"))))


def _weak_parts(pieces: DataFrame, inner: DataFrame) -> DataFrame:
    """(source, piece, weak) -> parts: split by the weak delimiters, keeping runs that are known values.

    `inner` (source, key): the known values with a weak delimiter inside. The longest run of parts that is one of them, as written, stays whole, from
    the left; runs are tried up to the most parts that any known value has.
    """
    every = _union(list(WEAK))
    most = inner.agg(F.max(F.size(F.split("key", every, -1)))).first()[0] or 1  # one number
    distinct = pieces.select("source", "piece", "weak").distinct()
    cut = distinct.withColumn("raw", F.split("piece", F.col("weak"), -1)).withColumn("marks", F.regexp_extract_all("piece", F.concat(F.lit("("), F.col("weak"), F.lit(")")), F.lit(1)))
    # where each part begins and ends in the piece, blank ones left out
    spans = F.aggregate(
        F.sequence(F.lit(0), F.size("raw") - 1),
        F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<begin:int,end:int>>").alias("done")),
        lambda a, i: F.struct(
            (a["at"] + F.length(F.get("raw", i)) + F.coalesce(F.length(F.get("marks", i)), F.lit(0))).alias("at"),
            F.when(_blank(F.get("raw", i)), a["done"]).otherwise(F.concat(a["done"], F.array(F.struct(a["at"].alias("begin"), (a["at"] + F.length(F.get("raw", i))).alias("end"))))).alias("done"),
        ),
        lambda a: a["done"],
    )
    cut = cut.select("source", "piece", "weak", spans.alias("spans"))

    def run(i: Column, k: Column | int) -> Column:
        begin = F.get("spans", i - 1)["begin"]
        return F.substring("piece", begin, F.get("spans", i + k - 2)["end"] - begin)

    def lengths(i: Column) -> Column:
        """2, 3 ... up to what `most` and the parts from the i-th allow."""
        top = F.least(F.lit(most), F.size("spans") - i + 1)
        return F.when(top >= 2, F.sequence(F.lit(2), top)).otherwise(F.array().cast("array<int>"))

    starts = F.when(F.size("spans") > 0, F.sequence(F.lit(1), F.size("spans"))).otherwise(F.array().cast("array<int>"))
    runs = F.flatten(F.transform(starts, lambda i: F.transform(lengths(i), lambda k: run(i, k))))
    tried = cut.select("source", "piece", "weak", F.explode(F.array_distinct(F.concat(F.array("piece"), runs))).alias("run")).withColumn("key", value_key(F.col("run")))
    hits = tried.join(broadcast_if_small(inner, MAX_BROADCAST_ROWS), ["source", "key"], "left_semi").groupBy("source", "piece", "weak").agg(F.collect_set("key").alias("keys"))
    with_keys = cut.join(hits, ["source", "piece", "weak"], "left").withColumn("keys", F.coalesce("keys", F.array().cast("array<string>")))

    def step(done: Column, i: Column) -> Column:
        k = F.coalesce(F.array_max(F.filter(lengths(i), lambda k: F.array_contains("keys", value_key(run(i, k))))), F.lit(1))
        skip = F.when(F.size(done) > 0, F.element_at(done, -1)["next"]).otherwise(F.lit(1)) > i
        return F.when(skip, done).otherwise(F.concat(done, F.array(F.struct(run(i, k).alias("text"), (i + k).alias("next")))))

    empty = F.array().cast("array<struct<text:string,next:int>>")
    plain = F.transform(starts, lambda i: run(i, 1))
    folded = F.transform(F.aggregate(starts, empty, step), lambda x: x["text"])
    whole = F.array_contains("keys", value_key(F.col("piece"))) | (F.size("spans") < 2)
    return with_keys.select("source", "piece", "weak", F.when(whole, F.array("piece")).when(F.size("keys") == 0, plain).otherwise(folded).alias("parts"))


def unpack(df: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """One row (keys..., field, pos, value) per value of each field; pos counts the non-empty values from 1.

    Repeated (keys, field, text) count once. Null, blank and "[]" give no row. Quotes and brackets that enclose
    a value are removed, inner ones stay. Other columns of `df` are ignored, whatever their names. Keys may
    be null; rows whose keys are equal but whose texts differ are all unpacked.
    """
    ks = [f"__k{i}" for i in range(len(keys))]
    stack = F.explode(F.array(*(F.struct(F.lit(f).alias("source"), df[f].cast("string").alias("text")) for f in fields))).alias("x")
    rows = (
        df.select(*(df[k].alias(a) for k, a in zip(keys, ks)), stack)
        .select(*ks, "x.source", "x.text")
        .filter(~_blank(F.col("text")))
        .distinct()
        .withColumn("protected", protect(F.col("text")))
        .filter(~_blank(F.col("protected")))
        .withColumn("layout", _layout(F.col("protected")))
    )
    rows = checkpointed(rows)  # read six times below; the layouts are costly to find
    texts = checkpointed(rows.groupBy("source", "layout", "protected").agg(F.count("*").alias("n")))
    single = texts.filter(F.col("layout").isin("", "quoted!")).select("source", F.explode(F.array_repeat("protected", F.least("n", F.lit(MIN_SUPPORT)).cast("int"))).alias("piece"))
    decided = checkpointed(_decide(texts, _known(single)))
    pieces = _split(texts, decided).filter(F.col("layout").isin("", "quoted!") | (F.col("strong") != "")).select("source", "n", F.explode("pieces").alias("piece"))
    repeated = pieces.select("source", F.explode(F.array_repeat("piece", F.least("n", F.lit(MIN_SUPPORT)).cast("int"))).alias("piece"))
    known = checkpointed(_known(repeated))
    final = checkpointed(_decide(texts, known))
    split = _split(rows, final)
    easy = split.filter(F.col("weak") == "").select(*ks, "source", F.posexplode("pieces").alias("at", "piece")).select(*ks, "source", (F.col("at") + 1).alias("pos"), "piece")
    hard = split.filter(F.col("weak") != "").select(*ks, "source", "text", "weak", F.posexplode("pieces").alias("at", "piece"))
    inner = known.filter(reduce(lambda a, b: a | b, (F.col("key").rlike(p) for p in WEAK.values())))
    parts = _weak_parts(hard, checkpointed(inner))
    order = Window.partitionBy(*ks, "source", "text").orderBy("at", "sub")
    weak = (
        hard.join(parts, ["source", "piece", "weak"])
        .select(*ks, "source", "text", "at", F.posexplode("parts").alias("sub", "piece"))
        .filter(restore(F.col("piece")) != "")
        .withColumn("pos", F.row_number().over(order))
        .select(*ks, "source", "pos", "piece")
    )
    out = easy.unionByName(weak).withColumn("value", restore(F.col("piece"))).filter(F.col("value") != "")
    return out.select(*(F.col(a).alias(k) for k, a in zip(keys, ks)), F.col("source").alias("field"), "pos", "value")
