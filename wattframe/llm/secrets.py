"""Secret scan: candidates by shape, false positives removed by a random forest.

Built-in expressions and the JVM's own forest only. A candidate is a run of key
characters; the forest sees its length, how its character classes alternate, how much
of it the corpus's own words cover, the path it comes from and the words before it.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialise

#: A run of key characters, of one case or several; padding only ends it, so that it does not reach from a name to its value.
RUN = r"[A-Za-z0-9+/_\-]{16,}+=*+"
#: Fewest characters of a value that is assigned or announced.
VALUE = 4
#: Words that announce a value, at the end of a word; with what may stand between them and the value.
ANNOUNCE = r"""(?i)(token|secret|pass(?:wor[dt]|wd|phrase|code)?|pwd|pin|api.?key|access.?key|private.?key|credentials?|bearer)s?["'`]?[=:]*>?$"""
BETWEEN = r"""(?i)^["'`]?(=|:|:=|=>|->|==|is|was)["'`]?$"""
ASSIGNED = r"""[=:]>?["'`]?$"""
#: Values within a word: quoted, up to the closing quote; after a sign, up to a quote; after an announcing word, up to the end.
QUOTED = rf"""[=:]>?(["'`])((?:(?!\1)\S){{{VALUE},}})"""
BARE = rf"""[=:]>?(?!//)([^\s"'`=:>][^\s"'`]{{{VALUE - 1},}})"""
OPEN = rf"""{ANNOUNCE[:-len('>?$')]}(?<=[=:])>?([^\s"'`=:>]\S{{{VALUE - 1},}})"""
#: The same for a word of its own.
WHOLE_QUOTED = rf"""^(["'`])((?:(?!\1)\S){{{VALUE},}})"""
WHOLE_BARE = rf"""^([^\s"'`]\S{{{VALUE - 1},}})"""
#: What closes a sentence or a list is not part of a value without quotes.
CLOSING = r"""[,;.)\]}>"'`]+$"""
#: Characters kept of each of the two words before a candidate's word.
BEFORE = 64
#: Words that announce a secret, and words that announce a checksum or a number.
KEYWORDS = r"(?i)(token|secret|passw|pwd|api.?key|access.?key|private|credential|auth|bearer|signature)"
HARMLESS = r"(?i)(commit|revision|sha\d*|md5|checksum|digest|hash|etag|uuid|guid|isbn|card|phone|order|build|version)"
PATHS = r"(?i)(env|conf|secret|cred|deploy|\.ya?ml|\.json|\.ini|\.toml|\.pem)"
#: Most frequent words of the corpus that count as a dictionary.
DICTIONARY = 1000
#: Labelled findings the forest is fitted on, at most; trees and depth.
LABELLED, TREES, DEPTH = 4000, 20, 6
MASK = "[secret]"

FEATURES = [
    "length", "digits", "capitals", "marks", "hexadecimal", "letter_digit", "small_capital", "variety", "longest_letters", "coverage",
    "path", "path_depth", "keyword", "harmless", "assigned", "quoted", "address", "names",
]


def dictionary(docs: DataFrame, size: int = DICTIONARY) -> list[str]:
    """The most frequent words of three to eight letters, counted over all texts."""
    w = docs.select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("w")).where(F.length("w").between(3, 8))
    top = w.groupBy("w").count().orderBy(F.desc("count"), "w").limit(size)
    return [r.w for r in top.collect()]  # as many as ``size`` says


def candidates(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, path, finding_no, found, word, secret``: one row per candidate.

    A candidate is a run of 16 key characters or more, or a value of ``VALUE`` characters
    or more that is assigned or announced, without the blanks that a quoted one may hold.
    Every word is looked at by itself; the two words before it are read, not used up.
    """
    d = docs.where("text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("text_key"), F.coalesce("source", F.lit("")).alias("path"), F.split("text", r"\s+").alias("words"))
    word = lambda i: F.coalesce(F.get("words", i), F.lit(""))
    # the value stands after a sign, after an announcing word, or after both
    follows = lambda i: word(i - 1).rlike(f"{ASSIGNED}|{ANNOUNCE}") | (word(i - 1).rlike(BETWEEN) & word(i - 2).rlike(ANNOUNCE))
    places = F.filter(
        F.sequence(F.lit(0), F.size("words") - 1),
        lambda i: (F.length(word(i)) >= VALUE) & (word(i).rlike(f"{RUN}|[=:]\\S{{{VALUE}}}") | follows(i)),
    )
    d = d.select("*", F.posexplode(places).alias("at", "i"))
    i = F.col("i")
    d = d.withColumn("word", word(i)).withColumn("follows", follows(i))
    d = d.withColumn("found", F.concat_ws(" ", F.right(word(i - 2), F.lit(BEFORE)), F.right(word(i - 1), F.lit(BEFORE)), "word")).drop("words", "i")
    every = lambda pattern, group: F.regexp_extract_all("word", F.lit(pattern), F.lit(group))
    cut = lambda values: F.transform(values, lambda v: F.regexp_replace(v, CLOSING, ""))
    whole = F.concat(every(WHOLE_QUOTED, 2), cut(every(WHOLE_BARE, 1)))
    runs = F.filter(every(f"({RUN})", 1), lambda v: v.rlike("[A-Za-z0-9]"))
    values = F.concat(every(QUOTED, 2), cut(every(BARE, 1)), cut(every(OPEN, 2)), F.when(F.col("follows"), whole).otherwise(F.array().cast("array<string>")))
    values = F.filter(values, lambda v: F.length(v) >= VALUE)
    d = d.select("*", F.posexplode(F.array_distinct(F.concat(runs, values))).alias("part", "secret")).drop("follows")
    return d.withColumn("finding_no", F.struct("at", "part")).drop("at", "part")


def features(found: DataFrame, words: list[str]) -> DataFrame:
    c = F.col("secret")
    n = F.length(c).cast("double")
    share = lambda pattern: F.regexp_count(c, F.lit(pattern)) / n
    before = F.regexp_replace("found", r"\S+$", "")
    inside = F.expr("substring_index(word, secret, 1)")
    after = F.substring(F.col("word"), F.length(inside) + F.length(c) + 1, F.lit(1))
    lead = F.concat(before, inside)
    # longer words first, so that a short one does not hide them
    listed = "|".join(sorted(words, key=lambda w: (-len(w), w))) or "(?!)"
    covered = n - F.length(F.regexp_replace(F.lower(c), listed, ""))
    longest = F.array_max(F.transform(F.split(c, r"[^A-Za-z]+"), lambda x: F.length(x)))
    number = lambda b: b.cast("double")
    out = {
        "length": n,
        "digits": share("[0-9]"),
        "capitals": share("[A-Z]"),
        "marks": share(r"[+/_=\-]"),
        "hexadecimal": number(c.rlike("^([0-9a-f]+|[0-9A-F]+)$")),
        "letter_digit": share("[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])"),
        "small_capital": share("[a-z](?=[A-Z])|[A-Z](?=[a-z])"),
        "variety": F.size(F.array_distinct(F.split(c, ""))) / n,
        "longest_letters": longest / n,
        "coverage": covered / n,
        "path": number(F.col("path").rlike(PATHS)),
        "path_depth": number(F.regexp_count("path", F.lit("/"))),
        "keyword": number(lead.rlike(KEYWORDS)),
        "harmless": number(lead.rlike(HARMLESS)),
        "assigned": number(lead.rlike(r"""[=:]\s*["']?$""")),
        "quoted": number(lead.rlike("""["'`]$""") & after.rlike("""^["'`]""")),
        "address": number(F.col("word").rlike(r"://|@|\.[a-z]{2,5}(/|$)")),
        "names": number(after.rlike("^[=:]") | (c.rlike("=$") & after.rlike(r"^\S") & ~lead.rlike("""["'`]$"""))),
    }
    return found.withColumns({k: F.coalesce(v, F.lit(0.0)) for k, v in out.items()})


def labelled_findings(docs: DataFrame, most: int = LABELLED) -> DataFrame:
    """Findings with labels, at most ``most``: texts as in ``docs`` with ``label`` 1 for a secret.

    A bounded sample of rows lends the words around; secrets and look-alikes (card and
    order numbers, checksums, identifiers, addresses) are drawn from the row's hash. Findings
    labelled by hand can be used instead: any table with ``doc_id, text, source, label``, and
    with ``secret`` if a text holds other candidates besides.
    """
    lent = F.slice(F.filter(F.slice(F.split("text", r"\W+", 13), 1, 12), lambda w: F.length(w) > 2), 1, 4).alias("w")
    some = docs.where("text IS NOT NULL").select("source", lent, F.sha2("text", 512).alias("h"), F.sha2(F.concat(F.lit("2"), "text"), 512).alias("g"))
    some = some.orderBy("h", "source").limit(most)
    w = lambda i: F.coalesce(F.get("w", F.lit(i)), F.lit("item"))
    h, g = F.col("h"), F.col("g")
    b64 = lambda n: F.substring(F.base64(F.unhex(g)), 1, n)
    alnum = lambda n: F.regexp_replace(b64(n + 8), "[^A-Za-z0-9]", "")
    digits = lambda n: F.substring(F.regexp_replace(h, "[^0-9]", ""), 1, n)
    hexa = lambda n: F.substring(h, 5, n)
    letters = F.translate(F.substring(h, 60, 40), "0123456789", "ghjkmnpqrs")
    short = F.substring(alnum(24), F.lit(1), F.pmod(F.hash("g"), F.lit(8)) + 8)
    marked = F.concat(F.substring(short, 1, 4), F.element_at(F.array(*map(F.lit, "!#$%&*?@")), F.pmod(F.hash("g"), F.lit(8)) + 1), F.substring(short, 5, 20), F.element_at(F.array(*map(F.lit, "#!^~")), F.pmod(F.hash("h"), F.lit(4)) + 1), digits(2))
    t = lambda *x: F.concat_ws("", *[F.lit(y) if isinstance(y, str) else y for y in x])
    none = F.lit(None).cast("string")
    kinds: list[tuple[int, Column, Column]] = [
        (1, v := hexa(40), t(w(0), " ", w(1), ' token = "', v, '" ', w(2))),
        (1, v := F.upper(hexa(40)), t(w(0), ' API_KEY: "', v, '" ', w(1))),
        (1, v := b64(40), t(w(0), " secret=", v, " ", w(1))),
        (1, v := alnum(20), t(w(0), " password: '", v, "' ", w(1))),
        (1, v := b64(64), t(w(0), " Authorization: Bearer ", v, " ", w(1))),
        (1, v := F.concat(F.lit("ghp_"), alnum(36)), t(w(0), " ", w(1), " ", v, " ", w(2))),
        (1, v := F.concat(F.lit("AKIA"), F.upper(alnum(16))), t("aws_access_key_id = ", v, " ", w(1))),
        (1, v := b64(40), t(w(0), "\nAWS_SECRET_ACCESS_KEY=", v, "\nLOG_LEVEL=", w(1))),
        (1, v := b64(64), t(w(0), "\n", v, "\n", w(1))),
        (1, v := short, t(w(0), " password: '", v, "' ", w(1))),
        (1, v := short, t(w(0), " DB_PASSWORD=", v, " ", w(1))),
        (1, v := marked, t(w(0), " db_password=", v, " ", w(1))),
        (1, v := marked, t(w(0), ' pwd = "', v, '" ', w(1))),
        (1, v := short, t(w(0), " the password is ", v, " ", w(1))),
        (1, v := F.lower(short), t(w(0), ' passwd: "', v, '" ', w(1))),
        (1, v := F.substring(letters, 1, 32), t(w(0), ' api_key = "', v, '" ', w(1))),
        (1, v := F.upper(F.substring(letters, 1, 32)), t(w(0), " SECRET_KEY=", v, " ", w(1))),
        (1, v := F.substring(letters, 1, 10), t(w(0), " password=", v, " ", w(1))),
        (0, none, t(w(0), " ", w(1), " ", digits(16), " ", w(2))),
        (0, none, t("card ", digits(16), " ", w(1))),
        (0, none, t(w(0), " commit ", hexa(40), " ", w(1))),
        (0, none, t(w(0), " sha256: ", hexa(64), " ", w(1))),
        (0, none, t(w(0), " see https://www.example.com/", w(1), "/", w(2), "-", digits(12), " ", w(3))),
        (0, none, t(w(0), " ", F.initcap(w(1)), F.initcap(w(2)), F.initcap(w(3)), "Handler", digits(1), " ", w(0))),
        (0, none, t(w(0), " = ", w(1), "_", w(2), "_", w(3), "_2024_final ", w(0))),
        (0, none, t(w(0), ' token = "', F.repeat(F.substring(h, 1, 1), 8), '0000000000" ', w(1))),
        (0, none, t(w(0), ": ", w(1), "tion ", w(2), ": ", w(3), "ness")),
        (0, none, t(w(0), ' = "', w(1), w(2), '" ', w(3))),
        (0, none, t(w(0), " at ", digits(2), ":", F.substring(h, 8, 2), ":30:00 ", w(1), ":2024-01-", digits(2))),
        (0, none, t("the secret ", w(0), "ing of ", w(1), " token ", w(2), "ment and password ", w(3), "tion")),
        (0, none, t(w(0), " ", w(1), w(2), w(3), w(0), "ation ", w(1), "-", w(2), "-", w(3), "-like ", w(0))),
        (0, none, t(w(0), " ", F.upper(w(1)), "_", F.upper(w(2)), "_CONNECTION_LIMIT=", w(3), "ing")),
        (0, none, t(w(0), " phone: ", digits(10), " order=", digits(8), " ", w(1))),
        (0, none, t("contact: ", w(0), "@", w(1), ".com, see: ", w(2), ".html")),
    ]
    # two kinds for a row, so that a small table has each of them
    kind = F.pmod(F.hash("h"), F.lit(len(kinds)))
    both = F.explode(F.array(kind, F.pmod(kind + len(kinds) // 2, F.lit(len(kinds)))))
    some = some.select("*", both.alias("kind")).orderBy("h", "source", "kind").limit(most)
    pick = F.element_at(F.array(*[F.struct(F.lit(y).alias("label"), v.alias("secret"), x.alias("text")) for y, v, x in kinds]), (F.col("kind") + 1).cast("int"))
    return some.select(pick.alias("p"), "source", F.hash("h").cast("bigint").alias("doc_id")).select("doc_id", "p.text", "source", F.col("p.label").cast("double").alias("label"), "p.secret")


def assemble(df: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(df)


def train(labelled: DataFrame, words: list[str], trees: int = TREES, depth: int = DEPTH, seed: int = 11) -> RandomForestClassificationModel:
    """Fit on labelled findings; a label goes to every candidate of its text, or, if the secret is named, to those that share it."""
    known = (F.col("secret") if "secret" in labelled.columns else F.lit(None).cast("string")).alias("_known")
    texts = labelled.select(F.xxhash64("text").alias("text_key"), F.col("label").alias("_label"), known).dropDuplicates(["text_key"])
    found = features(candidates(labelled), words).join(texts, "text_key")
    same = F.col("secret").contains(F.col("_known")) | F.col("_known").contains(F.col("secret"))
    found = found.withColumn("label", F.when(F.coalesce(same, F.lit(True)), F.col("_label")).otherwise(0.0)).select(*FEATURES, "label")
    found = materialise(found.coalesce(4), "labelled-features")
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="onethird").fit(assemble(found))


def scan(docs: DataFrame, labelled: DataFrame | None = None, least: float = 0.5) -> DataFrame:
    """Every candidate with its features, ``probability`` and ``is_secret``.

    * A null or blank text has no candidates; neither has an empty table.
    * A null ``source`` is an empty path; a null ``doc_id`` is carried through.
    * Rows that repeat others have candidates of their own.
    * Without any labelled finding of either kind nothing can be learnt: every
      candidate is then taken for a secret.
    * Other columns are not read.
    """
    words = dictionary(docs)
    labelled = materialise(labelled_findings(docs), "labelled") if labelled is None else labelled
    found = features(candidates(docs), words)
    kinds = labelled.agg(F.count_distinct("label")).head()[0]
    if kinds < 2:
        return found.withColumn("probability", F.lit(1.0)).withColumn("is_secret", F.lit(True))
    scored = train(labelled, words).transform(assemble(found))
    p = F.round(vector_to_array("probability")[1], 6)
    return scored.withColumn("probability", p).withColumn("is_secret", F.col("probability") >= least).drop("features", "rawPrediction", "prediction")


def redact(docs: DataFrame, mask: str = MASK) -> DataFrame:
    """``docs`` with the secrets in ``text`` replaced by ``mask``; no row is dropped.

    Texts meet their secrets by the hash of the text, so copies and rows without
    ``doc_id`` are treated alike. Columns other than ``text`` stay as they are.
    """
    s = scan(docs).where("is_secret").groupBy("text_key").agg(F.collect_set("secret").alias("_found"))
    s = s.select(F.col("text_key").alias("_key"), F.array_sort("_found", lambda a, b: F.length(b) - F.length(a)).alias("_found"))
    d = docs.withColumn("_key", F.xxhash64("text")).join(s, "_key", "left")
    # a short value may be part of other words: there it stays
    alone = lambda x: F.concat(F.lit(r"(?<![A-Za-z0-9])\Q"), F.replace(x, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(r"\E(?![A-Za-z0-9])"))
    gone = lambda text, x: F.when(F.length(x) < 16, F.regexp_replace(text, alone(x), F.lit(mask))).otherwise(F.replace(text, x, F.lit(mask)))
    clean = F.aggregate("_found", F.col("text"), gone)
    d = d.withColumn("text", F.when(F.col("_found").isNull(), F.col("text")).otherwise(clean))
    return d.select(*docs.columns)


def op9_secrets(spark, sf_dir):
    """Findings by document; the secret itself is shown as its hash."""
    f = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return f.select(
        "doc_id",
        F.col("finding_no.at").alias("finding_no"),
        F.col("finding_no.part").alias("part_no"),
        F.sha2("secret", 256).alias("secret_sha256"),
        *FEATURES,
        "probability",
        "is_secret",
    )
