"""Personal data by candidate gradient boosting, DataFrame functions only.

Base spans follow four fixed rules and always stay. Beside them, wider generators propose spans that
may overlap: addresses spelt with "at" and "dot", numbers in telephone shape without a plus sign,
card-like numbers with other separators, colon and bracket forms of network addresses. Boosted
trees score each proposal by its format and the words around it; a threshold per kind, calibrated
on held-out labelled rows to ``MIN_PRECISION``, selects the spans that are added. Everything is
inside the row: the spans of a document are arrays, the trees are CASE expressions, no row moves.

The trees are fitted by ``pyspark.ml`` on ``LABELLED_ROWS`` short labelled texts, written by a rule
from ``spark.range`` (so their number is a constant, whatever the corpus): the same generators run
over them, and a proposal is positive if it covers the planted span.

Defined cases: a null or empty text has no spans; null ids and repeated rows are ordinary rows; an
empty table gives an empty result; further columns are ignored by ``detect`` and kept by
``redacted``. Starting points inside a run of the same characters cannot match where its first one
does not, so patterns start at runs only and stay linear on very long texts.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesmill.functions.once import once
from seriesmill.llm.text import aside, restored, table

KINDS = ("email", "ip", "card", "phone")
LABELLED_ROWS = 3000
TREES, DEPTH, SEED = 12, 3, 7
MIN_PRECISION = 0.98
CONTEXT = 24
CHUNK = 256

# The base rules, anchored at the start of their runs.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Wider generators: (kind, pattern).
WIDER = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64}+\x20?(?:\(at\)|\[at\]|\x20at\x20)\x20?[A-Za-z0-9-]{2,63}+(?:\x20?\(dot\)\x20?|\x20?\[dot\]\x20?|\x20dot\x20|\.)[A-Za-z]{2,10}+"),
    ("ip", r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}+:){3,7}+:?[0-9A-Fa-f]{1,4}+(?![0-9A-Fa-f:])"),
    ("card", r"(?<![0-9])[0-9]{4}[._/][0-9]{4}[._/][0-9]{4}[._/][0-9]{1,7}(?![0-9])"),
    ("phone", r"(?<![0-9+().-])(?:00[0-9]{1,3}[\x20.-])?\(?[0-9]{3}\)?[\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}(?![0-9])"),
)
# Words that stand near personal data, by kind, and words near other numbers.
CUES = {
    "email": "mail|contact|write|reply|address",
    "ip": "ip|host|server|login|address|client",
    "card": "card|visa|master|amex|pay|credit",
    "phone": "call|phone|tel|fax|mobile|ring",
}
OTHER_CUES = "order|version|invoice|isbn|page|part|ratio|serial|time|score|price|chapter"


def _running(sizes: Column) -> Column:
    """Sums before each entry; in two levels, so long arrays aren't copied once per entry."""
    zero = F.array(F.lit(0))

    def grow(chunk: Column) -> Column:
        return F.aggregate(chunk, zero, lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    chunks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / CHUNK).cast("int")), lambda c: F.slice(sizes, c * CHUNK + 1, CHUNK)
    )
    return F.aggregate(
        chunks,
        zero,
        lambda acc, chunk: F.concat(
            acc, F.transform(F.slice(grow(chunk), 2, CHUNK), lambda x: x + F.element_at(acc, -1))
        ),
    )


NO_SPANS = "array<struct<s:int,e:int,m:string>>"


def _spans(rows: DataFrame, name: str, pattern: str, worth: Column) -> DataFrame:
    """Add an array of the matches of a pattern with their places in code points."""
    text = F.col("text")
    rows = once(rows, {"found": F.when(worth, F.regexp_extract_all(text, F.lit(pattern), 0)).otherwise(F.array().cast("array<string>"))})
    some = F.size("found") > 0
    pieces = F.when(some, F.transform(F.slice(F.split(text, pattern, -1), 1, F.size("found")), lambda p: F.length(p)))
    rows = once(rows, {"gaps": pieces})
    steps = F.zip_with("gaps", "found", lambda g, m: g + F.length(m))
    rows = once(rows, {"begins": F.when(some, _running(steps))})
    places = F.transform(
        "found",
        lambda m, i: F.struct(
            (F.get("begins", i) + F.get("gaps", i)).alias("s"),
            (F.get("begins", i) + F.get("gaps", i) + F.length(m)).alias("e"),
            m.alias("m"),
        ),
    )
    return once(rows, {name: F.when(some, places).otherwise(F.array().cast(NO_SPANS))}).drop("found", "gaps", "begins")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(
            F.split(m, r"\."), lambda x: F.regexp_replace(x, "^0+(?=[0-9])", "").rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")
        )
    n = F.length(_digits(m))
    if kind == "card":
        return n.between(13, 19) & F.when(n.between(13, 19), F.call_function("luhn_check", _digits(m))).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _valid_ones(kind: str) -> Column:
    return F.filter(f"all_{kind}", lambda x: _valid(kind, x["m"]))


def _base(rows: DataFrame) -> DataFrame:
    """Add base_<kind>: the spans of the base rules."""
    rows = once(rows, {"n_digits": F.length(F.regexp_replace("text", "[^0-9]+", ""))})
    worth = {
        "email": F.contains("text", F.lit("@")),
        "ip": F.col("n_digits") >= 4,
        "card": F.col("n_digits") >= 13,
        "phone": (F.col("n_digits") >= 9) & F.contains("text", F.lit("+")),
    }
    for kind in KINDS:
        rows = _spans(rows, f"all_{kind}", BASE[kind], worth[kind])
        rows = once(rows, {f"base_{kind}": _valid_ones(kind)}).drop(f"all_{kind}")
    return rows


FEATURES = (
    *[f"is_{k}" for k in KINDS],
    "length", "digits", "separators", "groups", "zeros", "luhn", "cue", "other_cue", "letter_before", "letter_after",
    "symbol_before", "symbol_after", "spelt",
)


def _features(kind: str, m: Column, before: Column, after: Column) -> list[Column]:
    digits = _digits(m)
    around = F.lower(F.concat(before, F.lit(" "), after))
    n = F.length(digits)

    def flag(c: Column) -> Column:
        return F.when(c, F.lit(1.0)).otherwise(F.lit(0.0))

    return [
        *[F.lit(float(k == kind)) for k in KINDS],
        F.length(m).cast("double"),
        n.cast("double"),
        F.length(F.regexp_replace(m, "[A-Za-z0-9]", "")).cast("double"),
        F.size(F.split(m, r"[^A-Za-z0-9]+")).cast("double"),
        (n - F.length(F.regexp_replace(digits, "0", ""))).cast("double"),
        flag(n.between(13, 19) & F.coalesce(F.call_function("luhn_check", F.when(n > 0, digits)), F.lit(False))),
        flag(around.rlike(rf"\b(?:{CUES[kind]})")),
        flag(around.rlike(rf"\b(?:{OTHER_CUES})")),
        flag(before.rlike(r"\p{L}$")),
        flag(after.rlike(r"^\p{L}")),
        flag(before.rlike(r"[#$%/=_-]\x20?$")),
        flag(after.rlike(r"^[#$%/=_-]")),
        flag(F.lower(m).rlike(r"[(\[](?:at|dot)[)\]]|dot")),
    ]


def _described(kind: str, spans: Column) -> Column:
    def row(x: Column) -> Column:
        before = F.substring(F.col("text"), F.greatest(x["s"] - CONTEXT, F.lit(0)) + 1, F.least(x["s"], F.lit(CONTEXT)))
        after = F.substring(F.col("text"), x["e"] + 1, F.lit(CONTEXT))
        values = F.array(*_features(kind, x["m"], before, after))
        return F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), values.alias("f"))

    return F.transform(spans, row)


def _proposals(rows: DataFrame) -> DataFrame:
    """Add wide: spans of the wider generators with their features, apart from base spans."""
    worth = {
        "email": F.lower(F.col("text")).rlike(r"[(\[\x20]at[)\]\x20].{0,70}(?:dot|\.)"),
        "ip": F.contains("text", F.lit(":")) & (F.col("n_digits") >= 2),
        "card": F.col("n_digits") >= 13,
        "phone": F.col("n_digits") >= 10,
    }
    taken = F.concat(*[F.col(f"base_{k}") for k in KINDS])
    rows = once(rows, {"taken": F.transform(taken, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))})
    for k, (kind, pattern) in enumerate(WIDER):
        rows = _spans(rows, f"met_{k}", pattern, worth[kind])
        free = F.filter(
            f"met_{k}",
            lambda x: ~F.exists("taken", lambda y: (x["s"] < y["e"]) & (y["s"] < x["e"])),
        )

        rows = once(rows, {f"wide_{k}": _described(kind, free)}).drop(f"met_{k}")
    names = [f"wide_{k}" for k in range(len(WIDER))]
    return once(rows, {"wide": F.concat(*names)}).drop("taken", *names)


def labelled(spark: SparkSession) -> DataFrame:
    """Short texts with one planted string each: columns text, s, e, positive; written by rule."""
    r = F.col("id")

    def pick(salt: int, n: int) -> Column:
        return F.pmod(F.xxhash64(r, F.lit(salt)), F.lit(n))

    def number(salt: int, size: int) -> Column:
        return F.lpad(F.pmod(F.xxhash64(r, F.lit(salt)), F.lit(10**size)).cast("string"), size, "1")

    def one_of(salt: int, words: list[str]) -> Column:
        return F.get(F.array(*[F.lit(w) for w in words]), pick(salt, len(words)).cast("int"))

    plain = "the record was kept there and nobody looked at it again until the spring came".split()
    people = ["jo.smith", "m.lind", "anna77", "r_okafor", "li.wei", "pat"]
    hosts = ["mail", "post-box", "example", "uni", "corp"]
    email = [
        F.concat(one_of(1, people), F.lit(" (at) "), one_of(2, hosts), F.lit(" (dot) "), one_of(3, ["com", "org", "net"])),
        F.concat(one_of(1, people), F.lit("[at]"), one_of(2, hosts), F.lit("."), one_of(3, ["com", "org", "net"])),
        F.concat(one_of(1, people), F.lit(" at "), one_of(2, hosts), F.lit(" dot "), one_of(3, ["com", "org", "net"])),
    ]
    not_email = [F.concat(one_of(1, plain), F.lit(" at "), one_of(2, plain), F.lit("."), F.initcap(one_of(3, plain)))]
    phone = [
        F.concat(number(4, 3), F.lit("-"), number(5, 3), F.lit("-"), number(6, 4)),
        F.concat(F.lit("("), number(4, 3), F.lit(") "), number(5, 3), F.lit("-"), number(6, 4)),
        F.concat(F.lit("0044 "), number(4, 3), F.lit(" "), number(5, 3), F.lit(" "), number(6, 4)),
    ]
    card = [F.concat_ws(".", number(7, 4), number(8, 4), number(9, 4), number(10, 4))]
    ip = [F.concat_ws(":", *[F.lower(F.hex(F.pmod(F.xxhash64(r, F.lit(11 + k)), F.lit(65536)))) for k in range(8)])]
    not_ip = [F.concat_ws(":", *[F.lpad(pick(11 + k, 60).cast("string"), 2, "0") for k in range(4)])]
    near = ["call me at ", "phone: ", "mail to ", "card number ", "server ip ", "contact ", "fax ", "tel. "]
    far = ["order no ", "version ", "invoice ", "isbn ", "part ", "serial ", "score ", "time "]
    shapes = [(x, True) for x in email + phone + card + ip] + [(x, False) for x in not_email + phone + card + not_ip]
    shape = pick(20, len(shapes)).cast("int")
    planted = F.get(F.array(*[x for x, _ in shapes]), shape)
    positive = F.get(F.array(*[F.lit(p) for _, p in shapes]), shape)
    # some of either have no telling word before them, so format and context both count
    lead = F.when(pick(25, 10) < 4, F.lit("")).when(positive, one_of(21, near)).otherwise(one_of(21, far))
    start = F.concat(one_of(22, plain), F.lit(" "), one_of(23, plain), F.lit(" "), lead)
    ids = spark.range(0, LABELLED_ROWS, 1, 2)
    made = once(ids, {"start": start, "planted": planted, "positive": positive})
    return made.select(
        "id",
        F.concat("start", "planted", F.lit(" "), one_of(24, plain)).alias("text"),
        F.length("start").alias("from"),
        (F.length("start") + F.length("planted")).alias("to"),
        "positive",
    )


def _tree(node, feature) -> Column:
    """A fitted tree as a CASE expression over an array of features."""
    if node.getClass().getSimpleName() == "LeafNode":
        return F.lit(float(node.prediction()))
    split = node.split()
    return F.when(
        feature(int(split.featureIndex())) <= F.lit(float(split.threshold())), _tree(node.leftChild(), feature)
    ).otherwise(_tree(node.rightChild(), feature))


def fitted(spark: SparkSession) -> tuple[object, dict[str, float]]:
    """The boosted trees and, by kind, the least score whose held-out precision is high enough."""
    rows = _proposals(_base(labelled(spark))).select("id", "from", "to", "positive", F.explode("wide").alias("w"))
    covers = F.col("positive") & (F.col("w.s") < F.col("to")) & (F.col("from") < F.col("w.e"))
    sample = rows.select(
        "id",
        F.col("w.kind").alias("kind"),
        covers.cast("double").alias("label"),
        *[F.get("w.f", F.lit(k)).alias(n) for k, n in enumerate(FEATURES)],
    )
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(sample).coalesce(2)
    learn = vectors.where(F.pmod(F.xxhash64("id", F.lit(99)), F.lit(4)) != 0)
    held_out = vectors.where(F.pmod(F.xxhash64("id", F.lit(99)), F.lit(4)) == 0)
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=SEED, cacheNodeIds=False).fit(learn)
    scored = held_out.withColumn("score", score(model, F.array(*FEATURES))).select("kind", "label", "score").collect()
    limits = {}
    for kind in KINDS:
        own = sorted(((r["score"], r["label"]) for r in scored if r["kind"] == kind), reverse=True)
        limits[kind], right = 2.0, 0.0
        for n, (value, label) in enumerate(own, 1):
            right += label
            if right / n >= MIN_PRECISION and (n == len(own) or own[n][0] < value):
                limits[kind] = value
    return model, limits


def score(model, f: Column) -> Column:
    """The probability that the trees give to an array of features."""
    total = F.lit(0.0)
    for tree, weight in zip(model.trees, model.treeWeights, strict=True):
        total = total + _tree(tree._java_obj.rootNode(), lambda k: F.get(f, F.lit(k))) * F.lit(float(weight))
    return 1.0 / (1.0 + F.exp(-2.0 * total))


def _detected(docs: DataFrame) -> DataFrame:
    """Add to each row the base spans and ``extra``, the spans that the trees add."""
    model, limits = fitted(docs.sparkSession)
    rows = docs.select(*aside(docs), "doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = _proposals(_base(rows))
    some = F.size("wide") > 0
    judged = F.transform("wide", lambda w: w.withField("p", score(model, w["f"])).dropFields("f"))
    kind_limit = F.create_map(*[F.lit(x) for k in KINDS for x in (k, limits[k])])
    rows = once(rows, {"judged": F.when(some, F.filter(judged, lambda w: w["p"] >= F.element_at(kind_limit, w["kind"])))})
    # of two that overlap, the likelier stays; of equals, the earlier
    best = F.filter(
        "judged",
        lambda w: ~F.exists(
            "judged",
            lambda v: (v["s"] < w["e"])
            & (w["s"] < v["e"])
            & ((v["p"] > w["p"]) | ((v["p"] == w["p"]) & ((v["s"] < w["s"]) | ((v["s"] == w["s"]) & (v["kind"] < w["kind"]))))),
        ),
    )
    none = F.array().cast("array<struct<kind:string,s:int,e:int,p:double>>")
    return once(rows, {"extra": F.coalesce(best, none)}).drop("wide", "judged")


def _written_spans(parts: list[Column]) -> Column:
    return F.array_join(F.concat(*parts), ",")


def _text_of(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda x: F.concat_ws(":", F.lit(kind), x["s"].cast("string"), x["e"].cast("string")))


def detect(docs: DataFrame) -> DataFrame:
    """One row per document: counts and digest of the base spans, and all spans."""
    rows = _detected(docs)

    def places(kind: str) -> Column:
        added = F.filter("extra", lambda x: x["kind"] == kind)
        both = F.concat(F.col(f"base_{kind}"), F.transform(added, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit("").alias("m"))))
        return F.when(F.size(added) > 0, F.sort_array(both)).otherwise(F.col(f"base_{kind}"))

    return rows.select(
        "doc_id",
        *[F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(_written_spans([_text_of(k, F.col(f"base_{k}")) for k in KINDS]), 256).alias("base_sha256"),
        _written_spans([_text_of(k, places(k)) for k in KINDS]).alias("spans"),
        F.size("extra").cast("long").alias("n_added"),
    )


def redacted(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by its kind in brackets; ``n_chars`` follows the text."""
    rows = _detected(docs)

    def tag(k: str) -> Column:
        return F.transform(f"base_{k}", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(k).alias("kind")))

    tagged = [tag(k) for k in KINDS]
    added = F.transform("extra", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind")))
    rows = once(rows, {"spans": F.sort_array(F.concat(*tagged, added))})
    # the text between spans, where later spans may begin inside earlier ones
    until = F.transform("spans", lambda x, i: F.array_max(F.transform(F.slice("spans", 1, i), lambda y: y["e"])))
    rows = once(rows, {"until": F.when(F.size("spans") > 0, until)})

    def piece(x: Column, i: Column) -> Column:
        end = F.coalesce(F.get("until", i), F.lit(0))
        gap = F.substring(F.col("text"), end + 1, F.greatest(x["s"] - end, F.lit(0)))
        return F.when(x["s"] >= end, F.concat(gap, F.lit("["), F.upper(x["kind"]), F.lit("]"))).otherwise(F.lit(""))

    last = F.array_max(F.transform("spans", lambda y: y["e"]))
    clean = F.concat(F.array_join(F.transform("spans", piece), ""), F.substring(F.col("text"), last + 1, F.length("text")))
    out = restored(docs)
    rows = once(rows, {"clean": F.when(F.size("spans") > 0, clean).otherwise(out["text"])})
    out["text"] = F.col("clean").alias("text")
    if "n_chars" in out:
        out["n_chars"] = F.length("clean").cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return rows.select(*out.values())


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(table(spark, sf_dir, "documents"))
