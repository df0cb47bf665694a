"""Secret scanning with a random forest over candidate tokens (operator 9, native).

Candidates come from one regular expression: values behind a secret's name and
long tokens. A forest trained on labelled findings judges each by length,
character transitions, dictionary coverage, path and neighbouring words, and so
removes false positives: hashes of commits, UUIDs, paths, identifiers, words.

The main path is one projection of Spark functions: a text is split at its
candidates, the neighbours are the pieces around each, features are a struct and
the forest is an expression over it. No Python; the only shuffle before it is that of
word counts, from which the ``words`` most frequent words of all texts become the
dictionary, beside a fixed list of words of code and paths. The forest is fitted by
Spark's MLlib on a table of labelled findings (before, token, after, label) that a
caller passes in; without one a made-up table of fixed size stands in. A fitted model
can be passed on instead, with the dictionary it was fitted with.

A candidate is what follows a secret's name and a sign, 6 characters at least, or 16
characters at least of letters, digits and ``_+/-``; shorter strings are no findings.
Features see the ``NEAR`` characters on either side of it and all of itself.

Null and empty texts have no candidates; a text without secrets stays the very
same; repeated rows come out once each; columns beside text are left alone. An empty
table has an empty dictionary. Findings all of one label make a forest that gives it.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import packed, with_text, written

# Names that stand before a secret, names that stand before a harmless token.
SECRET_NAMES = "password|passwd|passphrase|pwd|secret|token|api[_ -]?key|access[_ -]?key|private[_ -]?key|credential|bearer|authorization|auth"
HARMLESS_NAMES = "commit|revision|sha1|sha256|sha512|sha|md5|crc|checksum|digest|hash|uuid|guid|etag|integrity|blob|tree|parent|build|version|id|ref|isbn|serial|example|sample|base64"
#: Words that make up identifiers, paths and prose.
DICTIONARY = (
    "the and that this with from have will your name file data user test main class index list string value type code path page view "
    "model image table field group order config default service client server request response handler factory manager controller "
    "provider context element parent child node event message error result query update delete create insert select get set add remove "
    "build load save read write open close start stop init check find make http https www com org html json xml png jpg lib usr bin src "
    "home local share include python java script module package version example sample placeholder password token secret change here "
    "form access store account public private static final void return import function object array number"
).split()
#: The first look back is cheap and fails at nearly every place; the second one tries all names.
CANDIDATE = rf"(?<=[=:]\s{{0,2}}[\"']?)(?<=(?i:{SECRET_NAMES})[\"']?\s{{0,2}}[=:]\s{{0,2}}[\"']?)[^\s\"'<>,;]{{6,}}|[A-Za-z0-9_+/\-]{{16,}}={{0,2}}"
PREFIXES = r"^(AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|xox[abprs]-|[sr]k_(live|test)_|AIza|eyJ|SG\.|npm_|pypi-|hf_)"
PLACEHOLDER = r"(?i)(example|x{4,}|your|change_?me|dummy|placeholder|redacted|12345|abcdef|\*{3,}|\$\{|%s|\{\{)"
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
NEAR = 48  # characters of the text before and after a candidate that features look at
MARK = "[SECRET]"


def dictionary(docs: DataFrame, words: int = 2000) -> list[str]:
    """The most frequent words of 3 to 20 letters of whole texts, at most ``words``, ties in their order."""
    runs = F.explode(F.regexp_extract_all(F.lower(F.col("text").cast("string")), F.lit(r"(?<![\p{L}0-9_])\p{L}{3,20}(?![\p{L}0-9_])"), F.lit(0)))
    counts = docs.select(runs.alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    top = written(counts.orderBy(F.col("n").desc(), "w").limit(words))  # or each task would send the driver its own
    return sorted(r.w for r in top.collect())


def features(token: Column, left: Column, right: Column, known: list[str] = ()) -> dict[str, Column]:
    """Numbers about a candidate and the text around it; known: words of the dictionary."""
    n = F.length(token).cast("double")
    parts = F.transform(F.regexp_extract_all(token, F.lit(r"\p{Lu}?\p{Ll}+|\p{Lu}+"), F.lit(0)), F.lower)
    covered = F.aggregate(F.filter(parts, lambda w: w.isin(*known)), F.lit(0), lambda a, w: a + F.length(w)) if known else F.lit(0)
    share = lambda pattern: F.regexp_count(token, F.lit(pattern)) / n
    flag = lambda c: c.cast("double")
    words = "|".join(sorted(DICTIONARY, key=len, reverse=True))
    return {
        "length": n,
        "digits": share("[0-9]"),
        "uppers": share("[A-Z]"),
        "lowers": share(r"\p{Ll}"),
        "symbols": share(r"[^\p{L}0-9]"),
        "transitions": (F.regexp_count(token, F.lit(r"[0-9]+|[A-Z]+|\p{Ll}+|[^\p{L}0-9]+")) - 1) / n,
        "digit_runs": F.regexp_count(token, F.lit("[0-9]+")) / n,
        "vowels": share("[aeiouyAEIOUY]"),
        "clusters": share(r"(?i)[bcdfghjklmnpqrstvwxz]{4}"),
        "dictionary": 1 - F.length(F.regexp_replace(F.lower(token), words, "")) / n,
        "known": covered / n,
        "hex": flag(token.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")),
        "uuid": flag(token.rlike(UUID)),
        "prefix": flag(token.rlike(PREFIXES)),
        "placeholder": flag(token.rlike(PLACEHOLDER)),
        "slashes": share("[/.]"),
        "in_path": flag(left.rlike(r"(?:[/\\.@]|://\S*)$") | right.rlike(r"^(?:[/\\.]\w|\()")),
        "secret_name": flag(left.rlike(rf"(?i)(?:{SECRET_NAMES})[\"']?\W{{0,4}}$")),
        "harmless_name": flag(left.rlike(rf"(?i)(?:^|[^a-z])(?:{HARMLESS_NAMES})[\"']?\W{{0,4}}$")),
        "assigned": flag(left.rlike(r"[=:]\s?[\"']?$")),
        "quoted": flag(left.rlike("[\"']$") & right.rlike("^[\"']")),
    }


def labelled_findings(spark: SparkSession, rows: int = 4000) -> DataFrame:
    """A made-up table of labelled findings: before, token, after and label, from hashes of row numbers."""
    hashed = lambda k: F.sha2(F.concat(F.lit(f"{k}:"), F.col("id").cast("string")), 256)
    mixed = lambda k: F.regexp_replace(F.base64(F.unhex(F.concat(hashed(k), hashed(k + 1)))), "[^A-Za-z0-9]", "")
    pick = lambda k, *x: F.element_at(F.array(*[F.lit(v) for v in x]), (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(x))) + 1).cast("int"))
    size = lambda k, low, high: (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(high - low + 1)) + low).cast("int")
    cut = lambda c, n: F.substr(c, F.lit(1), n if isinstance(n, Column) else F.lit(n))
    word = lambda k: pick(k, *DICTIONARY)
    syllable = lambda k: pick(k, *"an er in on th re ti es or ou ed he nd st le de en que ment ción lich sch ung ra do".split())
    prose = F.concat(pick(90, "the ", "of ", "and ", "la ", "der ", "with "), word(91), F.lit(" "))
    name = pick(80, "password", "token", "api_key", "secret", "passwd", "access_key", "client_secret", "PASSWORD", "Token", "auth")
    sign = pick(81, "=", " = ", ": ", "=", '="', ' = "', "='")
    close = F.when(sign.endswith('"'), '"').when(sign.endswith("'"), "'").otherwise(" ")
    assigned = F.concat(prose, name, sign)
    plain = F.concat(F.lit(" "), word(92))
    kinds = [
        # secrets: values of secret names, provider keys, bare keys
        (1, assigned, cut(hashed(1), size(1, 14, 64)), close),
        (1, assigned, cut(mixed(2), size(2, 10, 44)), close),
        (1, assigned, F.concat(cut(word(3), 4), pick(3, "!", "@", "#", "$", "_"), cut(mixed(4), size(3, 5, 12))), close),
        (1, prose, F.concat(pick(5, "AKIA", "ASIA"), cut(F.upper(mixed(5)), 16)), plain),
        (1, pick(6, "x ", "key: ", "of ", "use "), F.concat(pick(7, "ghp_", "gho_", "glpat-", "sk_live_", "xoxb-", "npm_", "hf_"), cut(mixed(7), size(7, 24, 40))), plain),
        (1, F.lit("Authorization: Bearer "), F.concat(F.lit("eyJ"), cut(mixed(8), size(8, 24, 60))), F.lit("\n")),
        (1, assigned, cut(hashed(9), 40), close),
        # harmless: words, hashes, ids, paths, numbers, names, placeholders
        (0, prose, F.concat(*[syllable(k) for k in range(20, 29)]), plain),
        (0, prose, F.concat(*[syllable(k) for k in range(30, 42)]), F.lit(", ")),
        (0, F.concat(pick(10, "commit ", "sha256: ", "md5=", "checksum: ", "tree ", "parent ", "etag: \"", "digest=", "revision ", "sha256-")), cut(hashed(10), pick(11, 32, 40, 64)), plain),
        (0, F.concat(prose, pick(12, "id=", "uuid: ", "", "guid ", "ref ")), F.concat_ws("-", cut(hashed(12), 8), cut(hashed(13), 4), cut(hashed(14), 4), cut(hashed(15), 4), cut(hashed(16), 12)), plain),
        (0, pick(17, "/", "in /", "https://www.site.org/", "file:///", "./"), F.array_join(F.array(*[word(k) for k in range(40, 45)]), "/"), pick(19, "/", ".html", " ", ".py")),
        (0, prose, F.concat(word(45), F.initcap(word(46)), F.initcap(word(47)), F.initcap(word(48)), F.initcap(word(49))), pick(20, "(", " ", ".", ";")),
        (0, prose, F.concat_ws("_", word(50), word(51), word(52), word(53)), plain),
        (0, prose, F.rpad(cut(F.regexp_replace(hashed(21), "[a-f]", ""), size(22, 16, 24)), 16, "7"), plain),
        (0, assigned, pick(23, "your_password_here", "xxxxxxxxxxxxxxxx", "changeme123", "<placeholder>", "${SECRET_TOKEN}", "EXAMPLEKEY12345", "placeholder", "********"), close),
        (0, assigned, F.concat(word(54), pick(24, ".", "_", ""), F.initcap(word(55)), pick(25, "()", "", "_name", ".value")), close),
        (0, F.lit("data:image/png;base64,"), mixed(26), plain),
        (0, prose, F.concat(F.upper(word(56)), F.upper(word(57)), F.upper(word(58)), F.upper(word(59))), plain),
        (0, prose, F.rpad(F.lit(""), 24, "-"), plain),
        (0, prose, F.repeat(pick(27, "=", "_", "-", "a", "/"), 20), plain),
    ]
    cases = F.array(*[F.struct(before.alias("before"), token.alias("token"), after.alias("after"), F.lit(float(label)).alias("label")) for label, before, token, after in kinds])
    # half the rows are secrets
    secret, harmless = (sum(k[0] == want for k in kinds) for want in (1, 0))
    at = F.when(F.col("id") % 2 == 0, F.pmod(F.col("id") / 2, F.lit(secret)) + 1).otherwise(F.pmod((F.col("id") - 1) / 2, F.lit(harmless)) + secret + 1)
    return spark.range(0, rows, 1, 2).select(F.element_at(cases, at.cast("int")).alias("x")).select("x.*")


def fit(findings: DataFrame, known: list[str] = (), trees: int = 24, depth: int = 7, seed: int = 11) -> RandomForestClassificationModel:
    """A forest from labelled findings (before, token, after, label)."""
    columns = features(F.col("token"), F.col("before"), F.col("after"), known)
    rows = findings.select("label", *[c.alias(k) for k, c in columns.items()])
    rows = VectorAssembler(inputCols=list(columns), outputCol="x").transform(rows).select("label", "x")
    return RandomForestClassifier(labelCol="label", featuresCol="x", numTrees=trees, maxDepth=depth, minInstancesPerNode=4, seed=seed).fit(rows)


def judged(rows: DataFrame, model: RandomForestClassificationModel, known: list[str] = ()) -> DataFrame:
    """``rows`` of findings (before, token, after) with the model's score."""
    columns = features(F.col("token"), F.col("before"), F.col("after"), known)
    return rows.withColumn("_x", F.struct(*[c.alias(k) for k, c in columns.items()])).withColumn("score", forest(model, F.col("_x"), list(columns))).drop("_x")


def forest(model: RandomForestClassificationModel, x: Column, names: list[str]) -> Column:
    """The share of trees that vote for a secret, as one expression over the struct ``x``."""

    def node(n) -> Column:
        if n.getClass().getSimpleName() == "LeafNode":
            return F.lit(n.prediction())
        split = n.split()
        return F.when(x[names[split.featureIndex()]] <= split.threshold(), node(n.leftChild())).otherwise(node(n.rightChild()))

    trees = [node(t._call_java("rootNode")) for t in model.trees]
    total = trees[0]
    for t in trees[1:]:
        total = total + t
    return total / len(trees)


def scanned(docs: DataFrame, findings: DataFrame | None = None, model: tuple[RandomForestClassificationModel, list[str]] | None = None) -> DataFrame:
    """``docs`` with _pieces (text between candidates) and _found: token and score of each candidate."""
    if model is None:
        known = dictionary(docs)
        model = fit(labelled_findings(docs.sparkSession) if findings is None else findings, known), known
    trees, known = model
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    split = docs.withColumn("_tokens", F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))).withColumn("_pieces", F.when(F.size("_tokens") > 0, F.split(text, CANDIDATE, -1)).otherwise(F.array(text)))
    around = lambda t, k: (F.right(F.element_at("_pieces", k + 1), F.lit(NEAR)), F.left(F.element_at("_pieces", k + 2), F.lit(NEAR)))
    given = split.withColumn("_around", F.transform("_tokens", lambda t, k: F.struct(t.alias("token"), around(t, k)[0].alias("before"), around(t, k)[1].alias("after"))))
    names = list(features(F.lit(""), F.lit(""), F.lit("")))
    measured = given.withColumn("_x", F.transform("_around", lambda a: F.struct(a["token"].alias("token"), *[c.alias(n) for n, c in features(a["token"], a["before"], a["after"], known).items()])))
    return measured.withColumn("_found", F.transform("_x", lambda a: F.struct(a["token"].alias("token"), forest(trees, a, names).alias("score")))).drop("_tokens", "_around", "_x")


def findings(docs: DataFrame, threshold: float = 0.5, labelled: DataFrame | None = None) -> DataFrame:
    """doc_id, n_candidates and found (token, score) of every document."""
    out = scanned(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), labelled)
    return out.select("doc_id", F.size("_found").cast("long").alias("n_candidates"), F.filter("_found", lambda f: f["score"] >= threshold).alias("found"))


def masked(docs: DataFrame, threshold: float = 0.5, labelled: DataFrame | None = None) -> DataFrame:
    """``docs`` with every secret replaced by a mark; n_chars follows the text."""
    out = scanned(packed(docs, "text"), labelled)
    hit = F.exists("_found", lambda f: f["score"] >= threshold)
    shown = F.concat(F.transform("_found", lambda f: F.when(f["score"] >= threshold, MARK).otherwise(f["token"])), F.array(F.lit("")))
    text = F.array_join(F.flatten(F.zip_with("_pieces", shown, lambda p, s: F.array(p, s))), "")
    out = out.withColumn("_hit", hit).withColumn("_text", F.when(F.col("_hit"), text))
    return with_text(out, docs, F.col("_hit"), F.col("_text"))
