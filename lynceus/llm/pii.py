"""Personal data by boosted trees over proposed spans.

Base rules give the sure spans. Generators of high recall propose more spans, which may overlap: parts of what a base rule
swallowed whole and dropped, veiled addresses, national phone numbers. Each proposal has one code of its format and of
the words and signs around it. Gradient-boosted trees learn from counts of codes: proposals that are base spans are
positive, proposals that a base rule judged and dropped negative, those that it never judged teach nothing; a list of
labelled examples joins them. For each generator the lowest score whose decisions are right often enough on held-out
documents selects spans.

All of it is DataFrame code: regular expressions find matches, the pieces between matches give offsets, and since a
code's score is a cell of an array of ``CODES`` cells, texts are never shuffled and only counts of codes are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, small_batches

KINDS = ("email", "ip", "card", "phone")
#: Base rules. Possessive repeats need no memory of places to go back to, and as what follows never begins like what
#: repeats, they match the same; a run of letters is tried from its start (or the last match's end) only.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_AT = r"(?:\x20?[(\[{]\x20?at\x20?[)\]}]\x20?|\x20at\x20)"
_DOT = r"(?:\x20?[(\[{]\x20?dot\x20?[)\]}]\x20?|\x20dot\x20|\.)"
_BYTE = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
#: Generators: name, kind, pattern. Each is tried on texts that fit its kind's ``HINT``.
GENERATORS = (
    ("veiled", "email", rf"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{{1,64}}+{_AT}[a-z0-9-]{{1,63}}(?:{_DOT}[a-z0-9-]{{1,63}})+"),
    ("quad", "ip", rf"(?<![0-9]){_BYTE}(?:\.{_BYTE}){{3}}(?![0-9])"),
    ("digits", "card", r"(?<![0-9])[0-9]{13,19}(?![0-9])"),
    ("groups", "card", r"(?<![0-9])(?:[0-9]{4}([\x20.-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|3[47][0-9]{2}([\x20.-])[0-9]{6}\2[0-9]{5})(?![0-9])"),
    ("plus", "phone", r"\+[0-9]{1,3}(?:[\x20.-]?\([0-9]{1,4}\))?(?:[\x20.-]?[0-9]{2,4}){2,4}(?![0-9])"),
    ("plus_one", "phone", r"\+1[\x20.-]?\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4}(?![0-9])"),
    ("national", "phone", r"(?<![0-9+(])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])"),
)
HINT = {"email": "@", "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", "card": r"[0-9](?:[\x20.-]?[0-9]){12}", "phone": r"\+[0-9]"}
HINT_OF = {"veiled": r"(?i)[(\[{\x20]at[)\]}\x20]", "national": r"[0-9]{3}[\x20.-][0-9]{4}"}
#: Words before a span that tell its kind, and words that tell numbers of other uses.
CUES = {
    "email": r"(?i)(?:e-?mail|mail|contact|write|reach|address)\W{0,3}(?:\w+\W+){0,2}$",
    "ip": r"(?i)(?:\bip|\bhost|\bserver|\baddress|\bclient|\bfrom|\bby)\W{0,3}(?:\w+\W+){0,1}$",
    "card": r"(?i)(?:card|visa|mastercard|amex|credit|debit|payment)\W{0,3}(?:\w+\W+){0,2}$",
    "phone": r"(?i)(?:phone|tel|telephone|mobile|call|fax|cell|whatsapp|dial)\W{0,3}(?:\w+\W+){0,2}$",
}
OTHER_USE = r"(?i)(?:version|\bver|release|order|invoice|serial|isbn|ticket|hash|sha|token|key|id|\bno|number|section|build)\W{0,3}$"
#: Labelled examples: the text, and whether what the generators propose in it is personal.
EXAMPLES = (
    ("Please write to jane.doe (at) example (dot) com today.", True), ("mail: bob [at] example [dot] org", True), ("contact k.smith at example dot net for more", True),
    ("email sue {at} mail {dot} example {dot} com", True), ("reach me: tom (at) example.org", True), ("My address is lee_99 [at] example.co.uk.", True),
    ("we met at home.then left", False), ("look at this.That is it", False), ("he stayed at noon.Later he went", False), ("see you at ten.thirty", False),
    ("they laughed at me.and left", False), ("sold at 5.99 a piece", False), ("open at 9.30 daily", False), ("she works at acme.inc now", False),
    ("Call (212) 555-0147 now", True), ("tel. 415-555-0199", True), ("phone 646 555 0123 after six", True), ("mobile: (303) 555-0188.", True),
    ("fax 312.555.0100", True), ("my cell is 206-555-0165", True), ("dial 202-555-0111, ask for Ann", True), ("whatsapp (503) 555-0142", True),
    ("order 415-555-0199 was sent", False), ("serial 646 555 0123", False), ("ticket no 312.555.0100", False), ("id 206-555-0165 closed", False),
    ("part=415-555-0199/b", False), ("x415-555-0199", False), ("invoice 202-555-0111", False), ("isbn 312-555-0100", False),
    ("+1 (212) 555-0147", True), ("call +44 20 7946 0958", True), ("phone +49 30 90182 0", True), ("card 4111 1111 1111 1111", True),
    ("paid by visa 4012888888881881 yesterday", True), ("credit card 3782 822463 10005", True), ("token 4111111111111112", False), ("order 4111 1111 1111 1112", False),
    ("hash=41111111111111111a", False), ("server 192.0.2.17 answered", True), ("from 198.51.100.3:443", True), ("version 1.2.3.4", False),
    ("release 10.0.0.1-rc", False), ("section 1.1.2.3.4", False), ("build 2.10.0.7", False),
)
#: An example counts as so many proposals of the corpus; and what share of a generator's selected proposals must be right.
EXAMPLE_WEIGHT, PRECISION = 5, 0.95
TREES, DEPTH = 12, 3
#: Of a code, from the lowest digit: name of the feature and how many values it has.
FEATURES = (
    ("generator", len(GENERATORS)), ("valid", 2), ("left", 3), ("right", 3), ("cue", 2), ("other_use", 2), ("digits", 4), ("plain_signs", 2),
)
CODES = 1
for _, _n in FEATURES:
    CODES *= _n
SPAN = "array<struct<kind:int,start:int,end:int>>"
CHAIN = 256


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def scan(items: Column, kind: str, zero: Column, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """Goes through an array with a state: ``step`` of state and item gives the next state and the item put out (of type ``kind``).
    Items are put out in chains of 256, so that time grows with their number and not with its square."""
    blocks = let(items, lambda a: F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(a), F.lit(1)) - 1) / CHAIN).cast("int")), lambda b: F.slice(a, b * CHAIN + 1, F.lit(CHAIN))))

    def one(acc: Column, x: Column) -> Column:
        return let(F.struct(*(c.alias(n) for c, n in zip(step(acc["state"], x), ("state", "out")))), lambda r: F.struct(r["state"].alias("state"), F.array_append(acc["out"], r["out"]).alias("out")))

    def block(acc: Column, b: Column) -> Column:
        inner = F.aggregate(b, F.struct(acc["state"].alias("state"), F.array().cast(f"array<{kind}>").alias("out")), one)
        return let(inner, lambda r: F.struct(r["state"].alias("state"), F.array_append(acc["outs"], r["out"]).alias("outs")))

    return F.flatten(F.aggregate(blocks, F.struct(zero.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("outs")), block)["outs"])


MATCH = "struct<start:int,end:int,value:string,before:string,after:string>"


def matches(text: Column, pattern: str, hint: str) -> Column:
    """All matches from the left without overlaps, with start and end in code points and up to 40 signs before and after.
    Texts without the hint are not searched."""
    both = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("value"))
    sizes = F.transform(both, lambda z: F.struct(F.length(z["gap"]).alias("gap"), F.coalesce(F.length(z["value"]), F.lit(0)).alias("size"), z["value"].alias("value"), F.right(z["gap"], F.lit(40)).alias("before"), F.left(z["gap"], F.lit(40)).alias("after")))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + x["gap"]
        return start + x["size"], F.struct(start.alias("start"), (start + x["size"]).alias("end"), x["value"].alias("value"), x["before"].alias("before"), x["after"].alias("after"))

    placed = scan(sizes, MATCH, F.lit(0), step)
    # The signs after a match are those of the next piece between matches.
    following = let(placed, lambda p: F.zip_with(p, F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), lambda a, b: F.struct(*(a[c].alias(c) for c in ("start", "end", "value", "before")), b["after"].alias("after"))))
    found = F.filter(following, lambda m: m["value"].isNotNull())
    return F.when(F.contains(text, F.lit(hint)) if hint == "@" else text.rlike(hint), found).otherwise(F.array().cast(f"array<{MATCH}>"))


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def valid(kind: str, value: Column) -> Column:
    """Whether a match of the kind's rule stays."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return value.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        return let(digits_of(value), lambda d: F.length(d).between(13, 19) & F.coalesce(F.call_function("luhn_check", d), F.lit(False)))
    return F.length(digits_of(value)).between(9, 15)


def base_spans(text: Column) -> Column:
    """Spans of the base rules by kind, then start."""

    def of_kind(k: int, kind: str) -> Column:
        stays = F.filter(matches(text, BASE[kind], HINT[kind]), lambda m: valid(kind, m["value"]))
        return F.transform(stays, lambda m: F.struct(F.lit(k).alias("kind"), m["start"].alias("start"), m["end"].alias("end")))

    return F.concat(*(of_kind(k, kind) for k, kind in enumerate(KINDS)))


#: How a base rule goes on beyond a proposal on either side, and so does not judge it alone.
GOES_ON = {
    "email": (r"[A-Za-z0-9._%+-]$", r"^[A-Za-z0-9-]|^\.[A-Za-z0-9-]"), "ip": (r"[0-9]\.?$", r"^[0-9]"), "card": (r"[0-9][\x20-]?$", r"^[\x20-]?[0-9]"),
    "phone": (r"\+[0-9][\x20().0-9-]*$", r"^[\x20().-]*[0-9]"),
}
#: Generators whose proposals a base rule judges as well.
JUDGED = {"quad", "digits", "groups", "plus", "plus_one"}
PROPOSAL = "struct<code:int,start:int,end:int,label:int>"


def proposals(text: Column) -> Column:
    """Proposed spans of all generators: code, start, end, label (1 a base span, 0 judged and dropped, null not judged by a base rule)."""

    def of_generator(g: int, name: str, kind: str, pattern: str) -> Column:
        def one(m: Column) -> Column:
            v, before, after = m["value"], m["before"], m["after"]
            n = F.length(digits_of(v))
            parts = {
                "generator": F.lit(g), "valid": (valid(kind, v) if name in JUDGED else v.rlike(r"(?i)[a-z]{2}$|[0-9]{4}$")).cast("int"),
                "left": F.when(before.rlike(r"[A-Za-z0-9]$"), 2).when(before.rlike(r"[=/#_@.:-]$"), 1).otherwise(0),
                "right": F.when(after.rlike(r"^[A-Za-z0-9_]"), 2).when(after.rlike(r"^[=/#@.:-][A-Za-z0-9]"), 1).otherwise(0),
                "cue": before.rlike(CUES[kind]).cast("int"), "other_use": before.rlike(OTHER_USE).cast("int"),
                "digits": F.when(n < 9, 0).when(n < 13, 1).when(n < 16, 2).otherwise(3), "plain_signs": (~v.rlike(r"[(\[{)\]}]|\x20at\x20.*\x20dot\x20")).cast("int"),
            }
            code, weight = F.lit(0), 1
            for feature, size in FEATURES:
                code, weight = code + parts[feature] * weight, weight * size
            label = F.lit(None).cast("int")
            if name in JUDGED:  # where the base rule meets the proposal and nothing more
                alone = ~before.rlike(GOES_ON[kind][0]) & ~after.rlike(GOES_ON[kind][1]) & ~(F.lit(name == "groups") & v.contains("."))
                label = F.when(alone, parts["valid"])
            return F.struct(code.cast("int").alias("code"), m["start"].alias("start"), m["end"].alias("end"), label.alias("label"))

        return F.transform(matches(text, pattern, HINT_OF.get(name, HINT[kind])), one).cast(f"array<{PROPOSAL}>")

    return F.concat(*(of_generator(g, *rest) for g, rest in enumerate(GENERATORS)))


def proposed(docs: DataFrame, text: str, keep: list[Column]) -> DataFrame:
    """The kept columns with ``base`` and ``more``, as a written table."""
    small_batches(docs.sparkSession)
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return materialize(docs.select(*keep, base_spans(t).cast(SPAN).alias("base"), proposals(t).alias("more")), "spans")


def _features(code: Column) -> dict[str, Column]:
    out, weight = {}, 1
    for name, size in FEATURES:
        out[name] = F.floor(code / weight) % size
        weight *= size
    return out


def train(spark: SparkSession, spans: DataFrame, held_out: Column) -> DataFrame:
    """One row: ``scores``, an array with the score of each code, or null where the code's spans are not selected.

    ``spans`` has the columns of ``proposed`` and those ``held_out`` needs. Trees learn from counts over all documents
    that are not held out, and from the examples; both give counts for at most ``CODES`` codes, so the fit's table has a
    size that no corpus changes. A generator's threshold is the lowest score above which at least ``PRECISION`` of the
    labelled proposals of held-out documents and examples, less one, are positive; without such a score it adds nothing.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    own = spans.select(held_out.alias("later"), F.explode("more").alias("m")).where("m.label is not null").select("later", "m.code", "m.label", F.lit(1).alias("w"))
    texts = spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(t).alias("text"), F.lit(int(y)).alias("label")) for t, y in EXAMPLES))).alias("e")).select("e.*")
    taught = texts.select(proposals(F.col("text")).alias("more"), "label").select(F.explode("more").alias("m"), "label", F.lit(EXAMPLE_WEIGHT).alias("w"))
    taught = taught.crossJoin(spark.range(2).select((F.col("id") == 1).alias("later")))
    counts = own.union(taught.select("later", "m.code", "label", "w")).groupBy("later", "code", "label").agg(F.sum("w").cast("double").alias("w"))
    counts = materialize(counts.coalesce(1).sortWithinPartitions("later", "code", "label"), "counts")
    everything = spark.range(CODES).select(F.col("id").cast("int").alias("code"))
    columns = [f"{name}_{v}" for name, size in FEATURES for v in (range(size) if size > 2 else [1])]

    def vectors(df: DataFrame) -> DataFrame:
        values = _features(F.col("code"))
        flags = {f"{name}_{v}": (values[name] == v).cast("double") for name, size in FEATURES for v in (range(size) if size > 2 else [1])}
        return VectorAssembler(inputCols=columns, outputCol="features").transform(df.withColumns(flags)).drop(*columns)

    learner = GBTClassifier(labelCol="label", weightCol="w", maxIter=TREES, maxDepth=DEPTH, seed=7)
    model = learner.fit(vectors(counts.where("not later").select("code", F.col("label").cast("double").alias("label"), "w")))
    scored = materialize(model.transform(vectors(everything)).select("code", F.round(vector_to_array("probability")[1], 9).alias("score")).coalesce(1), "scores")
    seen = counts.where("later").groupBy("code").agg(F.sum(F.col("w") * F.col("label")).alias("right"), F.sum("w").alias("all"))
    up_to = Window.partitionBy("generator").orderBy(F.desc("score")).rangeBetween(Window.unboundedPreceding, 0)  # a generator has at most CODES rows
    generator = F.col("code") % len(GENERATORS)
    curve = seen.join(scored, "code").withColumn("generator", generator).select("generator", "score", F.sum("right").over(up_to).alias("right"), F.sum("all").over(up_to).alias("all"))
    bound = curve.where(F.col("right") >= PRECISION * (F.col("all") - EXAMPLE_WEIGHT)).where("score >= 0.5 and right > 0").groupBy("generator").agg(F.min("score").alias("bound"))
    chosen = scored.withColumn("generator", generator).join(F.broadcast(bound), "generator", "left").select("code", F.when(F.col("score") >= F.col("bound"), F.col("score")).alias("score"))
    return materialize(chosen.agg(F.transform(F.sort_array(F.collect_list(F.struct("code", "score"))), lambda s: s["score"]).alias("scores")), "model")


def _added(base: Column, more: Column, scores: Column) -> Column:
    """Selected proposals that overlap no base span; of those that overlap one another the better one, of equals the earlier and longer."""
    kind_of = F.array(*(F.lit(KINDS.index(kind)) for _, kind, _ in GENERATORS))
    item = "struct<start:int,found:int,stop:int,score:double,kind:int>"
    picked = F.transform(
        F.filter(more, lambda m: F.get(scores, m["code"]).isNotNull() & ~m["label"].eqNullSafe(F.lit(1))),
        lambda m: F.struct(m["start"].alias("start"), F.lit(1).alias("found"), (-m["end"]).alias("stop"), F.get(scores, m["code"]).alias("score"), F.get(kind_of, m["code"] % len(GENERATORS)).alias("kind")),
    )
    sure = F.transform(base, lambda b: F.struct(b["start"].alias("start"), F.lit(0).alias("found"), (-b["end"]).alias("stop"), F.lit(1.0).alias("score"), b["kind"].alias("kind")))

    def clear(items: Column, edge: Callable[[Column], Column], other: Callable[[Column], Column]) -> Column:
        """Drops additions that reach beyond the furthest edge of the base spans gone through."""
        wrapped = f"struct<item:{item},free:boolean>"

        def step(at: Column, x: Column) -> tuple[Column, Column]:
            is_base = x["found"] == 0
            return F.when(is_base, F.greatest(at, edge(x))).otherwise(at), F.struct(x.alias("item"), (is_base | (other(x) >= at)).alias("free"))

        return F.transform(F.filter(scan(items, wrapped, F.lit(-(1 << 31)).cast("int"), step), lambda w: w["free"]), lambda w: w["item"])

    ahead = clear(F.array_sort(F.concat(sure, picked).cast(f"array<{item}>")), lambda x: -x["stop"], lambda x: x["start"])  # ends of those before
    behind = clear(F.reverse(ahead), lambda x: -x["start"], lambda x: x["stop"])  # starts of those after
    free = F.array_sort(F.filter(behind, lambda x: x["found"] == 1))
    # An addition replaces the one before it if they overlap and it scores higher; otherwise it gives way.
    none = F.lit(None).cast(item)
    pair = f"struct<gone:{item}>"

    def meet(last: Column, x: Column) -> tuple[Column, Column]:
        apart = last.isNull() | (x["start"] >= -last["stop"])
        return F.when(apart | (x["score"] > last["score"]), x).otherwise(last), F.struct(F.when(apart, last).otherwise(none).alias("gone"))

    settled = F.transform(scan(F.array_append(free, F.struct(F.lit(2147483647).alias("start"), F.lit(1).alias("found"), F.lit(-2147483647).alias("stop"), F.lit(0.0).alias("score"), F.lit(0).alias("kind")).cast(item)), pair, none, meet), lambda p: p["gone"])
    return F.transform(F.filter(settled, lambda x: x.isNotNull()), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), (-x["stop"]).alias("end")))


def find_spans(spans: DataFrame, model: DataFrame) -> DataFrame:
    """``spans`` with ``added``: the selected proposals. The model is one row."""
    none = F.array().cast(SPAN)
    any_chosen = F.exists("more", lambda m: F.get("scores", m["code"]).isNotNull() & ~m["label"].eqNullSafe(F.lit(1)))
    return spans.crossJoin(F.broadcast(model)).withColumn("added", F.when(any_chosen, _added(F.col("base"), F.col("more"), F.col("scores")).cast(SPAN)).otherwise(none)).drop("scores", "more")


def listed(spans: Column) -> Column:
    """kind:start:end by kind, then start, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame, held_out: Column, text: str = "text", keep: list[Column] | None = None) -> DataFrame:
    """The kept columns (doc_id by default), ``base`` and ``added``: arrays of kind (0 to 3, as in ``KINDS``), start and end in code points.

    ``held_out`` marks documents that only calibrate. Base spans of different kinds may overlap; an added span overlaps no
    other one. Null text counts as empty, repeated rows each for itself, a text of any length is searched whole, an
    empty table gives an empty result; other columns are ignored. Without proposals in the corpus the examples alone teach.
    """
    keep = keep or [F.col("doc_id")]
    spans = proposed(docs, text, [*keep, held_out.alias("_later")])
    return find_spans(spans, train(docs.sparkSession, spans, F.col("_later"))).drop("_later")


def redact(docs: DataFrame, held_out: Column, text: str = "text") -> DataFrame:
    """``docs`` with each span of personal data replaced by [KIND]; of base spans that overlap, the first one counts and the rest goes with it. Null texts stay null."""
    columns = docs.columns
    found = personal_data(docs, held_out, text, [F.struct(*(F.col(c) for c in columns)).alias("_row")])
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    t = F.col("_row")[text]
    spans = F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    pieces = scan(spans, "struct<text:string>", F.lit(0), lambda at, s: (
        F.greatest(at, s["end"]), F.struct(F.when(s["start"] >= at, F.concat(F.substring(t, at + 1, s["start"] - at), F.get(names, s["kind"]))).otherwise(F.lit("")).alias("text"))))
    last = F.coalesce(F.array_max(F.transform(spans, lambda s: s["end"])), F.lit(0))
    new = F.concat(F.array_join(F.transform(pieces, lambda p: p["text"]), ""), F.substring(t, last + 1, F.length(t)))
    return found.select(*(new.alias(c) if c == text else F.col("_row")[c].alias(c) for c in columns))
