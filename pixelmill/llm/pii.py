"""Personal data by bootstrapped contextual extraction, in DataFrame expressions only.

Base patterns give the seeds.  What stands beside a seed makes two lexical patterns for its kind: the word before it and
a blank, or, where it begins within a word, the part of the word before it; and likewise what follows it.  Looser shapes
give candidates that are not yet known.  In each round a pattern's confidence is the share of all its occurrences in the
corpus that stand beside a known entity of the kind (it needs MIN_SEEDS different ones); a candidate value's score is one
minus the product of the doubts of all patterns it stands beside; values at or above ACCEPT become known for the next
round, wherever they stand, and make further patterns.  Rounds end when none adds a value.  Occurrences are those of
whole words, or of longer words that begin (for what follows: end) with the part; words that do not fit into WINDOW
characters are no patterns.  Pattern and value scores are grouped sums; only (kind, value, pattern) edges are joined.

Matches are leftmost and non-overlapping.  The regular expressions are written so that Java's matcher needs neither
recursion nor a second try within a run of characters; texts of any length are linear.  Texts that lack a character which
all matches of a kind have are not searched for it.

Defined cases: a null text is empty; rows are judged each for itself; ties of start go by kind in the order of KINDS;
empty tables give empty results; extra columns of any name pass through `redact`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, cols, fresh, spool

KINDS = ("email", "ip", "card", "phone")
LOCAL = "[A-Za-z0-9._%+-]"
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: Stands for a single separator between digits while cards are looked for; in texts it is another control first.
JOINT, OTHER = "\x01", "\x02"
BASE = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": rf"(?<![0-9{JOINT}])(?:[0-9]{JOINT}?){{12,18}}[0-9](?![0-9{JOINT}])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
DOT = r" ?(?:\.|\(dot\)|\[dot\]|\[\.\]) ?"
#: Shapes of candidates, looser than the base patterns: also IPv6, and up to three separators between the digits of a card.
LOOSE = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++ ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]++(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]++)++",
    "phone": r"(?<![0-9.+-])(?<![0-9]:)\(?[0-9]{2,4}[)\x20.-][\x20().0-9-]{4,16}[0-9](?![0-9])",
    "card": r"[0-9](?<![0-9][\x20./_-]{0,3}[0-9])(?:[\x20./_-]{0,3}[0-9]){12,18}+(?![\x20./_-]{0,3}[0-9])",
    "ip": rf"(?<![0-9.])[0-9]{{1,3}}+(?:{DOT}[0-9]{{1,3}}+){{3}}(?![0-9])|(?<![0-9A-Za-z:])[0-9A-Fa-f]{{0,4}}+:[0-9A-Fa-f:]++(?![0-9A-Za-z])",
}
MIN_SEEDS, CONFIDENT, ACCEPT = 3, 0.5, 0.5
#: Characters beside a match that are looked at for its contexts.
WINDOW = 64
#: Most patterns or rows with new spans that are broadcast; beyond it they are joined by a shuffle.
MAX_BROADCAST = 500_000
SPAN = "struct<start:int,end:int,value:string,left:string,right:string>"


def digits_of(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        x = F.substring(back, i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, x).otherwise(2 * x - F.when(x > 4, F.lit(9)).otherwise(F.lit(0)))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$")
    if kind == "card":
        return luhn(digits_of(value))
    if kind == "phone":
        return F.length(digits_of(value)).between(9, 15)
    return F.lit(True)


def _plain(words: Column) -> Column:
    """Lower case, digits as 0."""
    return F.regexp_replace(F.lower(words), "[0-9]", "0")


def plausible(kind: str, value: Column) -> Column:
    """Whether a loose match can be an entity of its kind."""
    if kind == "phone":
        return F.length(digits_of(value)).between(7, 15)
    if kind == "ip":
        four = F.regexp_replace(value, DOT, ".").rlike(rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$")
        groups = F.size(F.filter(F.split(value, ":"), lambda g: g != ""))
        six = value.rlike("^(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}$")
        short = value.rlike("^(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*)?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*)?$") & groups.between(1, 7)
        return F.when(F.length(value) <= 45, four | six | short).otherwise(False)  # longer ones are no address, and not for a matcher that recurses
    return valid(kind, value)


def _possible(kind: str, text: Column, digits: Column, loose: bool) -> Column:
    """False only for texts that hold no match: digits is the number of their digits."""
    if kind == "email":
        at = F.contains(text, F.lit("@"))
        return at | F.contains(text, F.lit("(at)")) | F.contains(text, F.lit("[at]")) if loose else at
    if kind == "ip":
        return (digits >= 4) | F.contains(text, F.lit(":")) if loose else (digits >= 4) & F.contains(text, F.lit("."))
    if kind == "card":
        return digits >= 13
    return digits >= 7 if loose else (digits >= 9) & F.contains(text, F.lit("+"))


def matches(text: Column, pattern: str, possible: Column, original: Column | None = None) -> Column:
    """start, end (code points), value and contexts of each match: the word before and a blank, or the part of the match's
    own word before it, and likewise behind it; lower case, digits as 0.  Only where possible.  original: the text before
    digits were joined, if they were."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def shown(side: Column, start: Column) -> Column:
        """What stands beside a match, with the separators that the text has."""
        if original is None:
            return side
        return F.when(F.contains(side, F.lit(JOINT)), F.substring(original, start, F.length(side))).otherwise(side)

    def add(a: Column, s: Column) -> Column:
        start = a.end + F.length(s.gap)
        end = start + F.length(s.value)
        # one character more than the window shows whether its first word is whole; matches before are part of the words
        before = F.right(F.concat(a.tail, s.gap), F.lit(WINDOW + 1))
        before = shown(before, start - F.length(before) + 1)
        whole = F.when(F.length(before) > WINDOW, before).otherwise(F.concat(F.lit(" "), before))
        left = F.regexp_replace(F.regexp_extract(whole, r"\s(\S+\s*)$", 1), r"\s+$", " ")
        after = shown(s.after, end + 1)
        whole = F.when(F.length(after) > WINDOW, after).otherwise(F.concat(after, F.lit(" ")))
        right = F.regexp_replace(F.regexp_extract(whole, r"^(\s*\S+)\s", 1), r"^\s+", " ")
        span = F.struct(start.alias("start"), end.alias("end"), s.value.alias("value"), _plain(left).alias("left"), _plain(right).alias("right"))
        tail = F.right(F.concat(a.tail, s.gap, s.value), F.lit(WINDOW + 1))
        return F.struct(end.alias("end"), tail.alias("tail"), F.concat(a.out, F.array(span)).alias("out"))

    def behind(a: Column, s: Column) -> Column:
        after = F.left(F.concat(s.gap, a.head), F.lit(WINDOW + 1))
        return F.struct(F.left(F.concat(s.value, after), F.lit(WINDOW + 1)).alias("head"), F.concat(a.out, F.array(after)).alias("out"))

    none = F.array().cast(f"array<{SPAN}>")
    # as elements, not looked up by place within the lambda, where the text would be split again for each match
    before = F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda v, g: F.struct(v.alias("value"), g.alias("gap")))
    later = F.zip_with(found, F.slice(gaps, F.lit(2), F.size(found)), lambda v, g: F.struct(v.alias("value"), g.alias("gap")))
    afters = F.reverse(F.aggregate(F.reverse(later), F.struct(F.lit("").alias("head"), F.array().cast("array<string>").alias("out")), behind, lambda a: a.out))
    parts = F.zip_with(before, afters, lambda s, x: F.struct(s.value.alias("value"), s.gap.alias("gap"), x.alias("after")))
    spans = F.aggregate(parts, F.struct(F.lit(0).alias("end"), F.lit("").alias("tail"), none.alias("out")), add, lambda a: a.out)
    return F.when(possible & (F.size(found) > 0), spans).otherwise(none)


def joined_digits(text: Column) -> Column:
    """text, as long, with JOINT for each single blank or hyphen between digits."""
    return F.regexp_replace(F.translate(text, JOINT, OTHER), "(?<=[0-9])[ -](?=[0-9])", JOINT)


def _overlaps(span: Column, others: Column) -> Column:
    return F.exists(others, lambda o: (o.start < span.end) & (span.start < o.end))


def _valid_only(kind: str, column: str) -> Column:
    return F.filter(column, lambda s: valid(kind, s.value))


def _free(kind: str, column: str, taken: Column) -> Column:
    return F.filter(column, lambda s: ~_overlaps(s, taken) & plausible(kind, s.value))


def with_spans(docs: DataFrame, text_col: str) -> tuple[DataFrame, dict[str, str], dict[str, str]]:
    """docs with the valid base spans and the free loose ones of each kind; the names of these columns by kind."""
    helpers: list[str] = []

    def name(wanted: str) -> str:
        helpers.append(fresh(docs, wanted))
        return helpers[-1]

    text, digits, joined = name("_text"), name("_digits"), name("_joined")
    base, loose = {k: name(f"_base_{k}") for k in KINDS}, {k: name(f"_loose_{k}") for k in KINDS}
    out = docs.withColumn(text, F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    out = out.withColumn(digits, F.length(text) - F.length(F.regexp_replace(text, "[0-9]+", "")))
    out = out.withColumn(joined, F.when(F.col(digits) >= 13, joined_digits(F.col(text))).otherwise(""))
    for kind in KINDS:
        card = kind == "card"
        out = out.withColumn(base[kind], matches(F.col(joined if card else text), BASE[kind], _possible(kind, F.col(text), F.col(digits), False), F.col(text) if card else None))
        out = out.withColumn(loose[kind], matches(F.col(text), LOOSE[kind], _possible(kind, F.col(text), F.col(digits), True)))
    out = out.withColumns({base[k]: _valid_only(k, base[k]) for k in KINDS})
    taken = F.concat(*(F.col(base[k]) for k in KINDS))
    out = out.withColumns({loose[k]: _free(k, loose[k], taken) for k in KINDS})
    return out.drop(text, digits, joined), base, loose


def _occurrences(texts: DataFrame, contexts: DataFrame) -> DataFrame:
    """context, occurs: how often each of contexts ("<" before, ">" behind) stands in texts (text), beside whatever it is."""
    small = contexts.count() <= MAX_BROADCAST
    wanted = F.broadcast(contexts) if small else contexts
    words = spool(texts.select(F.explode(F.split(_plain(F.coalesce("text", F.lit(""))), r"\s+")).alias("word")).where("word <> ''").groupBy("word").agg(F.count("*").alias("n")))
    sides = [words.select(F.concat(F.lit("<"), "word", F.lit(" ")).alias("context"), "n"), words.select(F.concat(F.lit("> "), "word").alias("context"), "n")]
    for mark, touches, part in (("<", ~F.col("context").endswith(" "), F.left), (">", ~F.col("context").startswith("> "), F.right)):
        # as many lengths as fit into the window, at most
        lengths = [r[0] for r in contexts.where(F.col("context").startswith(mark) & touches).select(F.length("context") - 1).distinct().collect()]
        if lengths:
            length = F.explode(F.filter(F.array(*map(F.lit, sorted(lengths))), lambda k: k < F.length("word")))
            sides.append(words.select("word", "n", length.alias("length")).select(F.concat(F.lit(mark), part(F.col("word"), F.col("length"))).alias("context"), "n"))
    every = sides[0]
    for side in sides[1:]:
        every = every.unionByName(side)
    return every.join(wanted, "context").groupBy("context").agg(F.sum("n").alias("occurs"))


def find(docs: DataFrame, keep: list[str], text_col: str = "text") -> tuple[DataFrame, str, dict[str, str], DataFrame]:
    """The columns `keep` of docs with a row number and the base spans of each kind, written to the shared folder; the
    names of these columns; and the new spans: row, kind, start, end."""
    row = fresh(docs, "_row")
    found, base, loose = with_spans(docs, text_col)
    # written once: a second scan may be split otherwise and would number other rows
    held = spool(found.select(*cols(keep), F.monotonically_increasing_id().alias(row), *base.values(), *loose.values()))
    entities = None
    for columns, seed in ((base, True), (loose, False)):
        for kind, column in columns.items():
            part = held.select(F.col(row).alias("row"), F.explode(column).alias("s")).select("row", F.lit(kind).alias("kind"), "s.start", "s.end", F.lower("s.value").alias("value"), "s.left", "s.right", F.lit(seed).alias("seed"))
            entities = part if entities is None else entities.unionByName(part)
    entities = spool(entities)
    beside = F.explode(F.array(F.concat(F.lit("<"), "left"), F.concat(F.lit(">"), "right")))
    # one edge for a value and a pattern, with its weight: what a hot value or pattern repeats is summed before the shuffle
    edges = spool(entities.select("kind", "value", beside.alias("context")).where("length(context) > 1").groupBy("kind", "value", "context").agg(F.count("*").alias("n")))
    # only a context of MIN_SEEDS values, known or not, can become a pattern in any round
    contexts = spool(edges.groupBy("kind", "context").agg(F.count("*").alias("values")).where(F.col("values") >= MIN_SEEDS).select("context").distinct())
    occurs = spool(_occurrences((held if text_col in keep else docs).select(col(text_col).cast("string").alias("text")), contexts))
    known = spool(entities.groupBy("kind", "value").agg(F.max("seed").alias("known")))
    reached_before, values = -1, known.where("known").count()
    while values > reached_before:
        mine = edges.join(known, ["kind", "value"])
        scored = mine.where("known").groupBy("kind", "context").agg(F.count("*").alias("values"), F.sum("n").alias("hits")).where(F.col("values") >= MIN_SEEDS)
        scored = scored.join(occurs, "context").select("kind", "context", F.least(F.lit(0.999), F.col("hits") / F.col("occurs")).alias("confidence")).where(F.col("confidence") >= CONFIDENT)
        doubt = F.sum(F.log(1 - F.col("confidence")))
        reached = mine.join(scored, ["kind", "context"]).groupBy("kind", "value").agg((1 - F.exp(doubt)).alias("score"))
        known = spool(known.unionByName(reached.select("kind", "value", (F.col("score") >= ACCEPT).alias("known"))).groupBy("kind", "value").agg(F.max("known").alias("known")))
        reached_before, values = values, known.where("known").count()
    new = entities.where("NOT seed").join(known.where("known").select("kind", "value"), ["kind", "value"], "left_semi")
    return held, row, base, spool(new.select("row", "kind", "start", "end"))


def _order(kind: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, KINDS)), kind)


def listed(spans: Column) -> Column:
    """kind:start:end, by kind as in KINDS, then by start, joined by commas; spans: array of (place of kind, start, end, kind)."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


def _typed(kind: str, base: Column) -> Column:
    return F.transform(base, lambda s: F.struct(F.lit(KINDS.index(kind) + 1).cast("long").alias("place"), s.start.alias("start"), s.end.alias("end"), F.lit(kind).alias("kind")))


def summary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, counts of base spans by kind, base_sha256 and spans of each row."""
    held, row, names, new = find(docs, [id_col], text_col)
    extra = new.groupBy("row").agg(F.collect_list(F.struct(_order(F.col("kind")).cast("long").alias("place"), "start", "end", "kind")).alias("extra"))
    base = F.concat(*(_typed(k, F.col(names[k])) for k in KINDS))
    counts = [F.size(names[k]).cast("long").alias(f"n_{k}") for k in KINDS]
    joined = held.select(col(id_col), F.col(row).alias("row"), *counts, base.alias("base")).join(extra, "row", "left")
    every = F.when(F.col("extra").isNull(), F.col("base")).otherwise(F.concat("base", "extra"))
    return joined.select(col(id_col), *(f"n_{k}" for k in KINDS), F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(every).alias("spans"))


def _named(kind: str, column: str) -> Column:
    return F.transform(column, lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), F.lit(kind).alias("kind")))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with each span of personal data replaced by <KIND>."""
    held, row, names, new = find(docs, docs.columns, text_col)
    extra = fresh(held, "_extra")
    found = new.groupBy(F.col("row").alias(row)).agg(F.collect_list(F.struct("start", "end", "kind")).alias(extra))
    small = new.count() <= MAX_BROADCAST
    text = col(text_col).cast("string")
    whole = held.join(F.broadcast(found) if small else found, row, "left")
    base = F.concat(*(_named(k, names[k]) for k in KINDS))
    every = F.array_sort(F.when(F.col(extra).isNull(), base).otherwise(F.concat(base, F.col(extra))))

    def cut(a: Column, s: Column) -> Column:
        apart = s.start >= a.end
        put = F.concat(a.out, F.substring(text, a.end + 1, s.start - a.end), F.lit("<"), F.upper(s.kind), F.lit(">"))
        return F.struct(F.greatest(a.end, s.end).alias("end"), F.when(apart, put).otherwise(a.out).alias("out"))

    start = F.struct(F.lit(0).alias("end"), F.lit("").alias("out"))
    clean = F.aggregate(every, start, cut, lambda a: F.concat(a.out, F.substring(text, a.end + 1, F.length(text))))
    masked = F.when(F.size(every) > 0, clean).otherwise(text)
    return whole.select(*(masked.alias(c) if c == text_col else col(c) for c in docs.columns))
