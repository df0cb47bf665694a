"""Personal data by candidate gradient boosting (operator 12, native).

Generators of high recall propose spans of four kinds. The strict ones are fixed formats
with a check (parts of an address, Luhn's sum, a count of digits); what passes is always
reported. The loose ones propose what such formats miss: numbers written without a plus,
cards with other separators, addresses of version six, mail written with "(at)" or with
letters beyond ASCII. Boosted trees score each loose candidate by its format and the
words around it; those that reach their kind's threshold are reported too, unless they
overlap a strict span. Thresholds are calibrated on labelled candidates that the trees
have not seen: the lowest score from which on ``precision`` of the kind are right.

All of it is a projection of Spark functions over whole texts: a text is split at its
matches, offsets are running sums of lengths, the trees are one expression. No shuffle and
no Python. The trees are fitted by MLlib on labelled candidates (kind, before, token,
after, label) that a caller passes in; the data has none, so a made-up table of
``rows`` rows, a parameter, stands in. A fitted model can be passed on.

Offsets are code points, ends exclusive. Null and empty texts have no spans; repeated rows
come out once each; extra columns are left alone; an empty table has no rows. Very long
texts and very long runs of letters or digits take time in proportion: patterns start at
the head of a run only and never go back.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import packed, with_text, written

KINDS = ("email", "ip", "card", "phone")  # spans that start together are listed in this order
#: Strict formats. A match starts where a run starts or where the match before has ended.
STRICT = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
AT, DOT = r"(?:@|\s{0,2}[\[({]\s?(?:at|AT)\s?[\])}]\s{0,2})", r"(?:\.|\s{0,2}[\[({]\s?(?:dot|DOT)\s?[\])}]\s{0,2})"
LOOSE = {
    "email": rf"(?:(?<![\p{{L}}\p{{N}}._%+-])|\G)[\p{{L}}\p{{N}}._%+-]++{AT}[\p{{L}}\p{{N}}-]++(?:{DOT}[\p{{L}}\p{{N}}-]++)++",
    "ip": r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){2,7}+(?![0-9A-Za-z:])",
    "card": r"(?<![0-9A-Za-z])[0-9](?:[ ./_ -]{0,2}[0-9]){12,18}+(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z.+@#/_-])\(?[0-9](?:[ ()./-]{0,2}[0-9]){6,14}+(?![0-9A-Za-z_])",
    # numbers beside others, which the strict formats run into one
    "card beside": r"(?<![0-9A-Za-z])[0-9]{4}(?:[ ./_-]?[0-9]{4}){3}(?![0-9A-Za-z])",
    "phone beside": r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9A-Za-z])",
}
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Words that stand near personal data, by kind, and near harmless numbers.
NEAR_WORDS = {
    "email": "e-?mail|mail|contact|write to|courriel|correo|adresse",
    "ip": "ip|ipv6|address|host|server|login from|client|adresse|dirección",
    "card": "card|visa|master ?card|amex|credit|debit|payment|carte|karte|tarjeta",
    "phone": "tel|phone|telephone|call|mobile|cell|fax|whatsapp|telefon|téléphone|teléfono|móvil|handy",
}
HARMLESS = "order|invoice|isbn|issn|doi|ref|id|no|number|version|release|build|page|line|date|year|score|total|sum|serial|ticket|case|item|sku|time|at"
NEAR = 40  # characters before and after a candidate that features look at
FIELDS = "array<struct<start:int,kind:int,end:int,token:string,before:string,after:string>>"
BLOCK = 256


def running(lengths: Column) -> Column:
    """Running sums of an array, in blocks, so that long arrays cost in proportion to their length."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int")), lambda b: F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK)))
    sums = F.transform(blocks, total)
    ahead = F.transform(F.sequence(F.lit(1), F.size(sums)), lambda k: total(F.slice(sums, F.lit(1), k - 1)))
    return F.flatten(F.zip_with(blocks, ahead, lambda b, o: F.transform(F.sequence(F.lit(1), F.size(b)), lambda k: o + total(F.slice(b, F.lit(1), k)))))


def digits(token: Column) -> Column:
    return F.regexp_replace(token, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether the digits pass Luhn's sum."""
    at = lambda k: F.ascii(F.substring(number, k, F.lit(1))) - F.lit(48)
    twice = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    add = lambda s, k: s + F.when((F.length(number) - k) % 2 == 1, twice(at(k))).otherwise(at(k))
    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), add) % 10 == 0


def passes(kind: str, token: Column) -> Column:
    """The check of a strict format."""
    if kind == "ip":
        return token.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits(token)).between(14, 19), luhn(digits(token))).otherwise(False)
    if kind == "phone":
        return F.length(digits(token)).between(10, 15)
    return F.lit(True)


def spans(rows: DataFrame, name: str, formats: dict[str, str], may: dict[str, Column]) -> DataFrame:
    """``rows`` with column ``name``: the spans of the formats over ``_text``, as FIELDS, by start and kind.

    A format's name begins with its kind.
    """
    kinds = [f.split()[0] for f in formats]
    patterns = {str(j): p for j, p in enumerate(formats.values())}
    may = {str(j): may[k] for j, k in enumerate(kinds)}
    empty = F.array().cast("array<string>")
    found = {k: F.when(may[k], F.regexp_extract_all("_text", F.lit(p), F.lit(0))).otherwise(empty) for k, p in patterns.items()}
    rows = rows.withColumns({f"_t_{k}": c for k, c in found.items()})
    rows = rows.withColumns({f"_p_{k}": F.when(F.size(f"_t_{k}") > 0, F.split("_text", p, -1)) for k, p in patterns.items()})
    lengths = lambda k: F.zip_with(f"_t_{k}", F.slice(f"_p_{k}", F.lit(1), F.size(f"_t_{k}")), lambda t, p: F.length(t) + F.length(p))
    rows = rows.withColumns({f"_e_{k}": F.when(F.size(f"_t_{k}") > 0, running(lengths(k))) for k in patterns})

    def listed(k: str) -> Column:
        end = lambda j: F.element_at(f"_e_{k}", j + 1)
        around = lambda j: (F.right(F.element_at(f"_p_{k}", j + 1), F.lit(NEAR)), F.left(F.element_at(f"_p_{k}", j + 2), F.lit(NEAR)))
        fields = lambda t, j: F.struct((end(j) - F.length(t)).alias("start"), F.lit(KINDS.index(kinds[int(k)])).alias("kind"), end(j).alias("end"), t.alias("token"), around(j)[0].alias("before"), around(j)[1].alias("after"))
        return F.when(F.size(f"_t_{k}") > 0, F.transform(f"_t_{k}", fields)).otherwise(F.array().cast(FIELDS))

    rows = rows.withColumn(name, F.array_sort(F.concat(*[listed(k) for k in patterns])))
    return rows.drop(*[f"_{x}_{k}" for x in "tpe" for k in patterns])


def features(kind: Column, token: Column, before: Column, after: Column) -> dict[str, Column]:
    """Numbers about a candidate's format and the text around it."""
    flag = lambda c: c.cast("double")
    count = lambda pattern: F.regexp_count(token, F.lit(pattern)).cast("double")
    number = digits(token)
    near = lambda words: flag(before.rlike(rf"(?i)(?<![\p{{L}}\p{{N}}])(?:{words})(?:\W{{0,3}}\p{{L}}{{0,8}})?\W{{0,4}}$"))
    out = {f"is_{k}": flag(kind == j) for j, k in enumerate(KINDS)}
    out |= {f"near_{k}": near(w) for k, w in NEAR_WORDS.items()}
    return out | {
        "near_harmless": near(HARMLESS),
        "length": F.length(token).cast("double"),
        "digits": F.length(number).cast("double"),
        "separators": count(r"[^\p{L}0-9]"),
        "groups": count("[0-9]+"),
        "short_groups": count("(?<![0-9])[0-9]{1,2}(?![0-9])"),
        "threes": count("(?<![0-9])[0-9]{3}(?![0-9])"),
        "fours": count("(?<![0-9])[0-9]{4}(?![0-9])"),
        "dashes": count("[-]"),
        "dots": count("[.]"),
        "slashes": count("[/_]"),
        "colons": count(":"),
        "hex": count("[A-Fa-f]"),
        "letters": count(r"\p{L}"),
        "luhn": flag(F.when(F.length(number).between(13, 19), luhn(number)).otherwise(False)),
        "issuer": flag(number.rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))")),
        "zero": flag(number.startswith("0")),
        "plus": flag(token.startswith("+")),
        "bracket": flag(token.startswith("(")),
        "one_digit": flag(number.rlike(r"^(.)\1*$")),
        "year": flag(token.rlike("(?:^|[^0-9])(?:19|20)[0-9]{2}(?:$|[^0-9])")),
        "domain": flag(token.rlike(r"(?:\.|(?i:dot)\s?[\])}]\s{0,2})[a-z]{2,6}$")),
        "at": count("@"),
        "money": flag(before.rlike(r"[$€£=#%]\s?$") | after.rlike(r"^\s?(?:[$€£%]|(?i:eur|usd|kg|km|cm|mm|mb|gb)\b)")),
        "inside": flag(before.rlike(r"[\p{L}0-9_=+,.:/-]$") | after.rlike(r"^[\p{L}0-9_=+/]")),
    }


def labelled_candidates(spark: SparkSession, rows: int = 4000) -> DataFrame:
    """A made-up table of labelled candidates: kind, before, token, after and label, from hashes of row numbers."""
    number = lambda k, n: F.lpad(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(10**n)).cast("string"), n, "0")
    pick = lambda k, *x: F.element_at(F.array(*[F.lit(v) for v in x]), (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(x))) + 1).cast("int"))
    word = lambda k: pick(k, *"the of words reading la der unter casa with paper river from gris haus long side être niño".split())
    name = lambda k: F.concat(pick(k, "ana", "josé", "jörg", "li", "marie", "tom", "eva", "renée"), pick(k + 1, ".", "_", ""), pick(k + 2, "smith", "müller", "garcía", "long", "leduc", "w"))
    host = lambda k: F.concat(pick(k, "mail", "example", "post", "web", "firma"), pick(k + 1, "1", "", "-x", "7"))
    hexa = lambda k: F.substring(F.sha2(F.concat(F.col("id").cast("string"), F.lit(f":{k}")), 256), 1, 4)
    prose = F.concat(word(1), F.lit(" "), word(2), F.lit(" "))
    after = F.concat(pick(3, " ", ", ", ". ", "\n"), word(4))
    said = lambda k, *x: F.concat(prose, pick(k, *x), pick(k + 1, ": ", " ", " = ", " is ", ":"))
    sep = lambda k: pick(k, ".", "/", "_", "  ", " ")
    joined = lambda k, *x: F.concat_ws("|", *x) if k is None else F.regexp_replace(F.concat_ws("|", *x), r"\|", F.when(sep(k) == "/", "/").otherwise(sep(k)))
    # the last of sixteen digits makes Luhn's sum right
    first = F.concat(pick(10, "4", "51", "55", "37", "6011"), number(11, 14))
    head = F.substring(first, 1, 15)
    card = F.concat(head, F.element_at(F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.concat(head, d.cast("string"))), luhn), 1).substr(16, 1))
    four = lambda c: [F.substring(c, 4 * j + 1, 4) for j in range(4)]
    dashed = pick(20, "-", ".", " ", "/")
    kinds = [
        (1, 3, said(30, "tel", "phone", "call me at", "mobile", "Tel.", "fax", "téléphone", "Telefon", "teléfono"), F.concat_ws("", F.lit("("), number(31, 3), F.lit(") "), number(32, 3), F.lit("-"), number(33, 4))),
        (1, 3, said(34, "tel", "phone", "Phone", "mobile", "cell", "whatsapp", "Handy", "móvil"), F.concat(number(35, 3), dashed, number(36, 3), dashed, number(37, 4))),
        (1, 3, said(38, "tel", "phone", "Fax", "mobile", "call", "Telefon"), F.concat(F.lit("0"), F.substring(number(39, 4), F.lit(1), pick(152, 2, 3, 4)), pick(40, " ", "/", "-"), F.substring(number(41, 8), F.lit(1), pick(153, 6, 7, 8)))),
        (1, 3, said(42, "tel", "phone", "mobile", "téléphone"), F.concat_ws(" ", F.concat(F.lit("0"), number(43, 1)), number(44, 2), number(45, 2), number(46, 2), number(47, 2))),
        (1, 2, said(48, "card", "visa", "credit card", "payment", "Karte", "carte", "tarjeta"), joined(49, *four(card))),
        (1, 2, prose, joined(50, *four(card))),
        (1, 2, prose, card),
        (1, 2, prose, card),
        (1, 3, prose, F.concat(pick(140, "+1 (", "+44 (", "+34 ("), number(141, 3), F.lit(") "), number(142, 3), pick(143, "-", " "), number(144, 4))),
        (1, 3, prose, F.concat(F.lit("+"), number(145, 2), pick(146, "-", " ", "."), number(147, 3), pick(148, "-", " ", "."), number(149, 3), pick(150, "-", " ", ""), number(151, 4))),
        (1, 1, said(51, "ip", "IPv6", "address", "host", "server"), F.concat_ws(":", *[hexa(k) for k in range(52, 60)])),
        (1, 1, prose, F.concat(F.lit("2001:db8::"), hexa(60), F.lit(":"), hexa(61))),
        (1, 0, prose, F.concat(name(62), F.lit("@"), host(65), pick(67, ".com", ".org", ".de", ".fr", ".es", ".net"))),
        (1, 0, said(68, "mail", "contact", "e-mail", "write to"), F.concat(name(69), pick(72, " (at) ", "[at]", " [at] ", "(at)"), host(73), pick(75, " (dot) ", "[dot]", "."), pick(76, "com", "org", "de", "net"))),
        (0, 3, said(80, "order", "invoice", "ref", "ISBN", "id", "ticket", "no", "serial", "item"), F.concat(number(81, 3), dashed, number(82, 3), dashed, number(83, 4))),
        (0, 3, prose, F.concat(pick(84, "19", "20"), number(85, 2), dashed, number(86, 2), dashed, number(87, 2))),
        (0, 3, prose, number(88, 8)),
        (0, 3, prose, F.concat(number(89, 3), dashed, number(90, 4))),
        (0, 3, prose, F.concat_ws(" ", number(91, 2), number(92, 3), number(93, 3))),
        (0, 3, F.concat(prose, pick(94, "$", "€ ", "= ", "#")), F.concat(number(95, 4), dashed, number(96, 5))),
        (0, 3, prose, number(97, 12)),
        (0, 3, prose, F.concat_ws("-", number(98, 4), number(99, 4))),
        (0, 2, prose, number(100, 16)),
        (0, 2, said(101, "order", "id", "serial", "ref", "isbn"), number(102, 16)),
        (0, 2, prose, joined(103, number(104, 4), number(105, 4), number(106, 4), number(107, 4))),
        (0, 2, prose, F.rpad(number(108, 1), 16, "0")),
        (0, 2, prose, F.concat_ws(".", number(109, 2), number(110, 3), number(111, 3), number(112, 3), number(113, 3))),
        (0, 1, prose, F.concat_ws(":", number(114, 2), number(115, 2), number(116, 2))),
        (0, 1, said(117, "time", "at", "date"), F.concat_ws(":", number(118, 2), number(119, 2), number(120, 2), number(121, 2))),
        (0, 1, prose, F.concat(number(122, 1), F.lit("::"), number(123, 2))),
        (0, 0, prose, F.concat(word(124), F.lit("@"), word(125), F.lit("."), F.initcap(word(126)))),
        (0, 0, prose, F.concat(number(127, 3), F.lit("@"), number(128, 2), F.lit("."), number(129, 2))),
        (0, 0, prose, F.concat(word(130), pick(131, " (at) ", " [at] "), F.lit("the."), word(132))),
    ]
    cases = F.array(*[F.struct(F.lit(k).alias("kind"), before.alias("before"), token.alias("token"), after.alias("after"), F.lit(float(label)).alias("label")) for label, k, before, token in kinds])
    return spark.range(0, rows, 1, 2).select("id", F.element_at(cases, (F.pmod(F.xxhash64("id"), F.lit(len(kinds))) + 1).cast("int")).alias("x")).select("id", "x.*")


class Model:
    """Boosted trees over ``features`` and the least score of each kind."""

    def __init__(self, trees: GBTClassificationModel, names: list[str], thresholds: list[float]):
        self.names, self.thresholds = names, thresholds
        self._trees = [t._call_java("rootNode") for t in trees.trees]
        self._weights = trees.treeWeights

    def score(self, x: Column) -> Column:
        """The probability of personal data, as one expression over a struct of features."""

        def node(n) -> Column:
            if n.getClass().getSimpleName() == "LeafNode":
                return F.lit(float(n.prediction()))
            split = n.split()
            return F.when(x[self.names[split.featureIndex()]] <= split.threshold(), node(n.leftChild())).otherwise(node(n.rightChild()))

        margin = sum((F.lit(w) * node(t) for t, w in zip(self._trees, self._weights)), F.lit(0.0))
        return 1 / (1 + F.exp(-2 * margin))

    def selects(self, kind: Column, score: Column) -> Column:
        return F.coalesce(score >= F.element_at(F.array(*[F.lit(t) for t in self.thresholds]), kind + 1), F.lit(False))


def measured(candidates: DataFrame) -> DataFrame:
    """Labelled candidates with their features as columns."""
    columns = features(F.col("kind"), F.col("token"), F.col("before"), F.col("after"))
    return candidates.select("kind", "label", *[c for c in ("rest",) if c in candidates.columns], *[c.alias(k) for k, c in columns.items()])


def fit(candidates: DataFrame, precision: float = 0.99, trees: int = 20, depth: int = 4, seed: int = 5) -> Model:
    """Trees fitted on three quarters of the labelled candidates, thresholds calibrated on the rest.

    A kind without right candidates in that rest, or that never gets as precise, selects none.
    """
    names = list(features(F.lit(0), F.lit(""), F.lit(""), F.lit("")))
    quarter = F.pmod(F.xxhash64("before", "token", "after"), F.lit(4)) == 0
    rows = written(measured(candidates.withColumn("rest", quarter)))  # the trees read them again and again
    learn = VectorAssembler(inputCols=names, outputCol="x").transform(rows.where("NOT rest")).select("label", "x")
    model = Model(GBTClassifier(labelCol="label", featuresCol="x", maxIter=trees, maxDepth=depth, minInstancesPerNode=4, stepSize=0.3, seed=seed).fit(learn), names, [2.0] * len(KINDS))
    rest = rows.where("rest").select("kind", "label", F.struct(*names).alias("x")).select("kind", "label", F.round(model.score(F.col("x")), 3).alias("score"))
    levels = rest.groupBy("kind", "score").agg(F.sum("label").alias("right"), F.count("*").alias("all")).collect()  # 1,001 scores a kind at most
    for k in range(len(KINDS)):
        right = seen = 0
        for r in sorted((r for r in levels if r["kind"] == k), key=lambda r: -r["score"]):
            right, seen = right + r["right"], seen + r["all"]
            if right >= precision * seen and right:
                model.thresholds[k] = r["score"] - 0.0005
    return model


def detected(docs: DataFrame, model: Model | None = None, labelled: DataFrame | None = None) -> DataFrame:
    """``docs`` with _base, the strict spans, and _added, the loose ones that the model selects: start, kind, end, in this order."""
    model = model or fit(labelled_candidates(docs.sparkSession) if labelled is None else labelled)
    rows = docs.withColumn("_text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    text = F.col("_text")
    digit = text.rlike("[0-9]")
    strict = spans(rows, "_strict", STRICT, {"email": text.contains("@"), "ip": digit & text.contains("."), "card": digit, "phone": digit & text.contains("+")})
    right = lambda s: F.coalesce(*[F.when(s["kind"] == j, passes(k, s["token"])) for j, k in enumerate(KINDS)])
    strict = strict.withColumn("_base", F.filter("_strict", right)).drop("_strict")
    marked = text.contains("@") | text.rlike(r"[\[({]\s?(?:at|AT)\s?[\])}]")
    loose = spans(strict, "_loose", LOOSE, {"email": marked, "ip": text.contains(":"), "card": digit, "phone": digit})
    apart = lambda s: ~F.exists("_base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    loose = loose.withColumn("_loose", F.filter("_loose", apart))
    x = lambda s: F.struct(*[c.alias(n) for n, c in features(s["kind"], s["token"], s["before"], s["after"]).items()])
    seen = loose.withColumn("_x", F.transform("_loose", lambda s: F.struct(s.alias("s"), x(s).alias("x"))))
    judged = seen.withColumn("_x", F.transform("_x", lambda v: F.struct(v["s"].alias("s"), model.score(v["x"]).alias("score"))))
    chosen = F.filter("_x", lambda v: model.selects(v["s"]["kind"], v["score"]))
    better = lambda v: ~F.exists(chosen, lambda w: (w["s"]["start"] < v["s"]["end"]) & (v["s"]["start"] < w["s"]["end"]) & (F.struct(-w["score"], w["s"]["start"], w["s"]["kind"]) < F.struct(-v["score"], v["s"]["start"], v["s"]["kind"])))
    place = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))
    added = F.array_distinct(F.transform(F.filter(chosen, better), lambda v: place(v["s"])))  # two formats may propose one span
    return judged.withColumns({"_base": F.transform("_base", place), "_added": added}).drop("_loose", "_x", "_text")


def shown(found: Column) -> Column:
    """kind:start:end of spans, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def findings(docs: DataFrame, **how) -> DataFrame:
    """doc_id, counts of strict spans by kind, base (they, as text) and spans (with the added ones)."""
    out = detected(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), **how)
    of = lambda j: F.filter("_base", lambda s: s["kind"] == j)
    counts = [F.size(of(j)).cast("long").alias(f"n_{k}") for j, k in enumerate(KINDS)]
    return out.select("doc_id", *counts, shown(F.col("_base")).alias("base"), shown(F.array_sort(F.concat("_base", "_added"))).alias("spans"))


def redacted(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; of overlapping spans the first in order stands for all. n_chars follows."""
    out = detected(packed(docs, "text"), **how).withColumn("_all", F.array_sort(F.concat("_base", "_added")))
    text = F.col("text").cast("string")
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).alias("at"))
    cut = lambda a, s: F.when(s["start"] >= a["at"], F.struct(F.concat(a["parts"], F.array(F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.element_at(names, s["kind"] + 1))).alias("parts"), s["end"].alias("at"))).otherwise(F.struct(a["parts"].alias("parts"), F.greatest(a["at"], s["end"]).alias("at")))
    done = F.aggregate("_all", start, cut)
    out = out.withColumn("_done", F.when(F.size("_all") > 0, done))
    new = F.concat(F.array_join("_done.parts", ""), F.substring(text, F.col("_done.at") + 1, F.length(text)))
    return with_text(out, docs, F.size("_all") > 0, new)
