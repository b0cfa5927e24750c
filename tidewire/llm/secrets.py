"""Secret scans: candidates by pattern, false positives removed by a random forest. DataFrame and SQL functions only.

Candidates are found widely, and no rule says which are secrets:

- a run of 16 or more of ``[A-Za-z0-9_+/.~-]`` with a digit in it, and up to two ``=`` after it;
- a value of 6 to 200 characters, digits or not, that a name such as password or token stands before, with ``:`` or ``=`` between;
- a private key block, whole (of up to 20,000 characters), or its first line where it does not end.

Each is described by its length, shares of character classes and their transitions, entropy, how much of it dictionary words cover, its path
and the words next to it. The dictionary is the corpus: a letter run of a candidate is a word if it stands as a word in the texts ``COMMON`` times or more,
or is one of WORDS. A forest learns from labelled findings: the caller's, or ``planted`` ones, made texts whose truth is known because
they were made so: keys, tokens, passwords and key blocks on one side; digests, ids, card numbers, paths, hosts, versions, placeholders, code and
prose in the same places on the other. The forest alone decides on the candidates of the corpus.

Every text is scanned whole. Null and empty texts have no candidates. Candidates of one place are one, the longest. Rows of the same id and text are
reported once. The forest is fitted on a bounded sample of labelled candidates (MAX_ROWS, those of lowest hash); with no labels, or those of one
kind only, the score is the share of true ones.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import drop, table

RUN = r"[A-Za-z0-9_+/.~-]"
#: Parts of the names of secrets.
NAME = r"(?:token|secret|passw(?:or)?d|passphrase|pwd|api[_-]?key|access[_-]?key|auth|credential|bearer|private[_-]?key)"
#: Patterns of candidates; the candidate is the last group, which ends the match.
PATTERNS = (
    rf"(?<!{RUN})(?=[A-Za-z_+/.~-]*+[0-9])({RUN}{{16,}}+={{0,2}})",
    rf"(?i){NAME}[A-Za-z0-9_-]{{0,20}}[\"']?\s{{0,4}}(?:=>|[:=])\s{{0,4}}(?:bearer\s)?[\"']?([^\s\"'`,;<>(){{}}\[\]]{{6,200}}+)",
    r"(-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----(?:[A-Za-z0-9+/=\s:,-]{1,20000}?-----END [A-Z ]{0,30}PRIVATE KEY-----)?)",
)
MAX_ROWS, TREES, DEPTH, THRESHOLD = 20_000, 40, 8, 0.5
#: Times that a letter run must stand as a word in the corpus, and its least length.
COMMON, PART = 5, 3
#: Planted findings.
PLANTED = 6000
#: Words that names, hosts and samples are made of.
WORDS = "access admin api app auth aws bearer build cache client cloud code com config credential data database demo dev dummy email env example fake file host http https image index info key lib local login mail main master net org page pass password path placeholder private prod public redis repo sample secret server service session site src test token user version web www".split()
#: Frequent letter pairs of running text.
PAIRS = "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce".split()
NAMES = rf"(?i){NAME}[A-Za-z0-9_-]{{0,20}}[\"']?\s*(=>|[:=])?\s*(bearer\s)?[\"']?$"
LOWER, UPPER, DIGIT = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"

FEATURES = (
    "log_length lower upper digit hexadecimal other marks runs pairs vowels entropy distinct covered parts dots slashes block path_sample path_code path_depth "
    "named assigned quoted at_before sample_before sum_before slash_before padded quote_after paren_after word_before word_after"
).split()


def _matches(rows: DataFrame, pattern: str) -> DataFrame:
    """Candidates of one pattern in rows (_id, _path, _text), not yet one for each place."""
    sql = pattern.replace("\\", "\\\\").replace("'", "\\'")
    found = rows.where(F.col("_text").rlike(pattern)).select("_id", "_path", F.xxhash64("_text").alias("_th"), F.expr(f"regexp_extract_all(_text, '{sql}', 0)").alias("_c"), F.expr(f"regexp_extract_all(_text, '{sql}', 1)").alias("_v"), F.split("_text", pattern, -1).alias("_p"))
    n = F.size("_c")
    found = found.select("_id", "_path", "_th", F.posexplode(F.arrays_zip("_c", "_v", F.slice("_p", 1, n).alias("_l"), F.slice("_p", 2, n).alias("_r"))).alias("_i", "_x"))
    found = found.select("_id", "_path", "_th", "_i", "_x.*").dropDuplicates(["_id", "_th", "_i"])
    earlier = Window.partitionBy("_id", "_th").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.length("_l") + F.length("_c")).over(earlier)
    lead = F.left(F.col("_c"), F.length("_c") - F.length("_v"))  # the candidate ends the match
    return found.select("_id", "_path", "_th", (end - F.length("_v")).cast("long").alias("start"), F.col("_v").alias("finding"), F.right(F.concat("_l", lead), F.lit(48)).alias("before"), F.left("_r", F.lit(24)).alias("after"))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """(_id, _path, start, finding, before, after): every candidate, its place in code points, and up to 48 and 24 characters around it."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    path = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col in docs.columns else F.lit("")
    rows = docs.select(F.col(id_col).alias("_id"), path.alias("_path"), text.alias("_text"))
    found = reduce(DataFrame.union, [_matches(rows, p) for p in PATTERNS])
    longest = F.max_by(F.struct("_path", "finding", "before", "after"), F.struct(F.length("finding"), F.length("before"), "before", "after", "_path")).alias("x")
    return found.groupBy("_id", "_th", "start").agg(longest).select("_id", "x._path", "start", "x.finding", "x.before", "x.after")


def _parts(c):
    """A candidate's letter runs, cut where a capital follows a small letter, in lower case."""
    runs = F.split(F.lower(F.regexp_replace(c, "(?<=[a-z])(?=[A-Z])", " ")), "[^a-z]+")
    return F.filter(runs, lambda x: F.length(x) >= PART)


def dictionary(docs: DataFrame, found: DataFrame, text_col: str = "text") -> DataFrame:
    """(word): letter runs of the candidates that are words of the corpus, or of WORDS. Only they are counted; Spark sends them round where they are few."""
    parts = table(found.select(F.explode(F.array_distinct(_parts(F.col("finding")))).alias("word")).distinct(), "parts")
    words = docs.select(F.explode(F.split(F.lower(F.col(text_col)), r"[\s.,;:!?()\"]+")).alias("word")).where(F.length("word") >= PART)
    known = words.join(parts, "word", "left_semi").groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON).select("word")
    known = table(known.union(parts.where(F.col("word").isin(WORDS)).select("word")).distinct(), "words")
    drop(parts)
    return known


def cover(found: DataFrame, words: DataFrame) -> DataFrame:
    """``found`` with ``covered``, the share of its letters that dictionary words hold, and ``parts``, its letter runs. Equal findings are looked up once."""
    each = found.select("finding").distinct().withColumn("_w", F.explode(_parts(F.col("finding"))))
    hit = each.join(words.withColumnRenamed("word", "_w"), "_w").groupBy("finding").agg(F.sum(F.length("_w")).alias("_n"))
    letters = F.length(F.regexp_replace("finding", "[^A-Za-z]", ""))
    met = found.join(hit, "finding", "left")
    return met.withColumns({"covered": F.coalesce(F.col("_n") / F.greatest(letters, F.lit(1)), F.lit(0.0)), "parts": F.size(_parts(F.col("finding"))).cast("double")}).drop("_n")


def _share(c, keep: str):
    return (F.length(c) - F.length(F.translate(c, keep, ""))) / F.length(c)


def describe(found: DataFrame) -> DataFrame:
    """``found``, with what ``cover`` gives, with FEATURES."""
    c = F.col("finding")
    n = F.length(c).cast("double")
    kinds = F.translate(c, LOWER + UPPER + DIGIT + "+/.~-=", "a" * 26 + "A" * 26 + "0" * 10 + "______")
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    count = lambda of, p: F.regexp_count(of, F.lit(p)).cast("double")
    entropy = F.aggregate(F.array_distinct(F.split(c, "")), F.lit(0.0), lambda a, x: a - F.when(x == "", 0.0).otherwise((n - F.length(F.replace(c, x, F.lit("")))) / n * F.log2((n - F.length(F.replace(c, x, F.lit("")))) / n)))
    sample = r"(?i)\b(example|sample|dummy|fake|test|mock|placeholder|demo|spec)"
    columns = {
        "log_length": F.log(n), "lower": _share(c, LOWER), "upper": _share(c, UPPER), "digit": _share(c, DIGIT), "hexadecimal": _share(c, "0123456789abcdefABCDEF"), "other": _share(c, "_+/.~-="), "marks": _share(c, "!@#$%^&*?|\\:"),
        "runs": F.length(F.regexp_replace(kinds, r"(.)\1*", "x")) / n, "pairs": count(F.lower(c), "(?=" + "|".join(PAIRS) + ").") / n, "vowels": _share(c, "aeiouAEIOU"), "entropy": entropy, "distinct": F.size(F.array_distinct(F.split(c, ""))) / n,
        "dots": count(c, r"\."), "slashes": count(c, "/"), "block": flag(c.startswith("-----BEGIN")),
        "path_sample": flag(F.col("_path").rlike(sample)), "path_code": flag(F.col("_path").rlike(r"\.(py|js|ts|java|go|rb|sh|env|ya?ml|json|toml|ini|cfg|conf|properties)$")), "path_depth": count(F.col("_path"), "/"),
        "named": flag(F.col("before").rlike(NAMES)), "assigned": flag(F.col("before").rlike(r"[:=]\s*[\"']?$")), "quoted": flag(F.col("before").rlike("[\"'`]$")), "at_before": flag(F.col("before").rlike("@$")),
        "sample_before": flag(F.concat("before", c).rlike(r"(?i)(example|sample|dummy|fake|placeholder|changeme|your[_-]|xxxx|redacted)")),
        "sum_before": flag(F.col("before").rlike(r"(?i)(commit|sha|md5|digest|checksum|hash|etag|rev|uuid|id)[\"'(]?\s*[:=]?\s*[\"']?$")), "slash_before": flag(F.col("before").rlike("[/:.]$")), "padded": flag(c.endswith("=")), "quote_after": flag(F.col("after").rlike("^[\"'`]")), "paren_after": flag(F.col("after").rlike(r"^[(\[{<]")),
        "word_before": count(F.col("before"), r"\b[A-Za-z]{2,}\b"), "word_after": count(F.col("after"), r"\b[A-Za-z]{2,}\b"),
    }
    return found.withColumns(columns)


def _pick(h, values):
    """One of the values, by a hash."""
    if all(isinstance(v, str) for v in values):
        return F.element_at(F.split(F.lit("\0".join(values)), "\0", -1), (F.pmod(h, F.lit(len(values))) + 1).cast("int"))
    n, *rest = values
    at = F.pmod(h, F.lit(len(values)))
    return reduce(lambda c, v: c.when(at == v[0], v[1]), enumerate(rest, 1), F.when(at == 0, n))


def planted(spark: SparkSession, n: int = PLANTED) -> DataFrame:
    """(doc_id, text, path, start, is_secret): made texts with one finding each, half of them secrets. The same for every call.

    What a secret and what is none share their surroundings as often as they do in files: names stand before placeholders, code and prose, digests
    are as random as keys, and either comes in sources, tests and documents, or without a path.
    """
    i = F.col("id")
    h = lambda salt: F.xxhash64(i, F.lit(salt))
    hexa = lambda salt, k: F.left(F.sha2(F.concat_ws("-", i, F.lit(salt)).cast("binary"), 512), F.lit(k))
    sixty = lambda salt, k: F.left(F.base64(F.unhex(hexa(salt, 128))), F.lit(k))
    plain = lambda salt, k: F.left(F.regexp_replace(F.base64(F.unhex(hexa(salt, 128))), "[+/=\\s]", "x"), F.lit(k))
    letters = lambda salt, k: F.translate(plain(salt, k), DIGIT, "qzvkwjxgbp")
    word = lambda salt: _pick(h(salt), WORDS)
    number = lambda salt, k: F.lpad(F.pmod(h(salt), F.lit(10**k)).cast("string"), k, "7")
    name = _pick(h("name"), ["password", "passwd", "PASSWORD", "db_password", "token", "access_token", "API_TOKEN", "api_key", "apiKey", "secret", "client_secret", "SECRET_KEY", "auth_token", "AWS_SECRET_ACCESS_KEY", "private_key"])
    to = _pick(h("to"), [' = "', "=", ": ", '": "', " = '", ':"', " := "])
    prose = _pick(h("prose"), ["", "see the notes below\n", "import os\n\n", "# settings\n", "the service was moved last week. ", "export ", "- ", "    ", "set ", '{"'])
    named = F.concat(prose, name, to)
    bare = F.concat(prose, _pick(h("bare"), ["", "use ", "with ", "key ", "value ", "> ", "| "]))
    key_id = F.concat(_pick(h("ai"), ["AKIA", "ASIA"]), F.translate(F.upper(hexa("ak", 16)), "0123456789", "GHJK234567"))
    prefixed = F.concat(_pick(h("pre"), ["ghp_", "gho_", "sk_live_", "xoxb-", "glpat-", "AIza", "SG."]), plain("pk", 36))
    mixed = F.concat(F.initcap(word("p1")), number("p2", 3), _pick(h("p3"), ["!", "#", "$", "@", "%", "&", "*", "?"]), letters("p4", 3))
    block = F.concat(F.lit("-----BEGIN "), _pick(h("b"), ["RSA ", "EC ", "", "OPENSSH "]), F.lit("PRIVATE KEY-----\n"), sixty("b1", 64), F.lit("\n"), sixty("b2", 64), F.lit("\n"), sixty("b3", 40), F.lit("\n-----END "), _pick(h("b"), ["RSA ", "EC ", "", "OPENSSH "]), F.lit("PRIVATE KEY-----"))
    web = F.concat(F.lit("eyJ"), plain("w1", 30), F.lit("."), plain("w2", 60), F.lit("."), plain("w3", 43))
    uuid = lambda salt: F.concat_ws("-", hexa(salt, 8), F.right(hexa(salt, 12), F.lit(4)), F.right(hexa(salt, 16), F.lit(4)), F.right(hexa(salt, 20), F.lit(4)), F.right(hexa(salt, 32), F.lit(12)))
    size = lambda values: _pick(h("size"), [F.lit(v) for v in values])
    yes = [
        (named, F.left(hexa("x1", 64), size([20, 32, 40, 64]))), (named, F.left(sixty("x2", 88), size([22, 32, 44, 64]))), (bare, key_id), (named, key_id),
        (named, prefixed), (bare, prefixed), (named, mixed), (named, F.left(letters("x3", 20), size([8, 10, 14, 20]))), (F.concat(prose, F.lit("")), block), (F.concat(prose, F.lit("Authorization: Bearer ")), web),
        (named, uuid("x4")), (named, F.left(plain("x5", 60), size([12, 16, 24, 40]))), (F.concat(prose, name, F.lit(' = "')), F.left(hexa("x6", 64), size([32, 40, 40, 48]))),
    ]
    digest = F.concat(prose, _pick(h("dg"), ["commit ", "sha256:", "checksum = ", "md5: ", "digest ", "etag: \"", "rev ", "hash=", "integrity sha512-", "image@sha256:"]))
    ids = F.concat(prose, _pick(h("di"), ["id: ", "request_id=", "uuid ", "session ", "order ", "trace=", "doc/"]))
    holder = _pick(h("ph"), ["changeme", "your_token_here", "xxxxxxxxxxxxxxxx", "<redacted>", "${SECRET}", "$DB_PASSWORD", "example123", "placeholder", "********", "required", "string", "os.environ", "None", "undefined", "process.env.TOKEN", "settings.SECRET_KEY", "optional", "incorrect", "true", "expired", "dummy-password-1", "test1234"])
    camel = F.concat(word("c1"), F.initcap(word("c2")), F.initcap(word("c3")), number("c4", 1), F.initcap(word("c5")))
    snake = F.concat_ws("_", word("s1"), word("s2"), number("s3", 2), word("s4"), word("s5"))
    path_ = F.concat_ws("/", F.lit(""), word("t1"), word("t2"), F.concat(word("t3"), number("t4", 2)), F.concat(word("t5"), F.lit(".py")))
    host = F.concat(word("h1"), number("h2", 2), F.lit("."), word("h3"), F.lit("."), word("h4"), _pick(h("h5"), [".com", ".org", ".example.com", ".net"]))
    stamp = F.concat(F.lit("20"), number("d1", 2), F.lit("-0"), number("d2", 1), F.lit("-1"), number("d3", 1), _pick(h("d4"), ["T12.00.00Z", "-rc1.build7", ".1.0-beta.2", "_12.30.59.123"]))
    no = [
        (digest, F.left(hexa("y1", 128), size([32, 40, 64, 64]))), (digest, F.left(sixty("y2", 88), size([44, 64, 88, 88]))), (ids, uuid("y3")), (ids, F.left(hexa("y4", 32), size([16, 24, 32, 32]))),
        (F.concat(prose, _pick(h("cd"), ["card ", "account ", "invoice ", "tel ", "IBAN DE"])), number("y5", 16)), (named, holder), (named, holder), (named, F.concat(word("y6"), F.lit("."), word("y7"))), (bare, camel), (bare, snake), (named, snake),
        (bare, path_), (F.concat(bare, F.lit("https://")), host), (F.concat(bare, word("y8"), F.lit("@")), host), (bare, stamp), (F.concat(bare, F.lit("data:image/png;base64,")), sixty("y9", 88)), (named, path_),
    ]
    secret = F.pmod(h("label"), F.lit(2)) == 0
    both = lambda values: _pick(h("kind"), [F.struct(b.alias("b"), v.alias("v")) for b, v in values])
    path = _pick(h("path"), ["", "", "", "src3", "src/app/config.py", "deploy/.env", "app/settings.yaml", "tests/fixtures/sample.json", "docs/example.md", "src/lib/client.js", "notes.txt", "conf/prod.toml"])
    end = _pick(h("end"), ["\n", " and so on", ".", "\nnext = 1\n", " # set at start", ",\n"])
    side = lambda rows, values, label: rows.select("id", both(values).alias("x"), path.alias("path"), F.lit(label).alias("is_secret"), end.alias("end"))
    step = 4  # kinds in one plan, so that each is compiled
    made = [side(spark.range(n).where(secret == bool(label)).where(F.pmod(h("part"), F.lit(-(-len(kinds) // step))) == k), kinds[k * step : (k + 1) * step], label) for label, kinds in ((1, yes), (0, no)) for k in range(-(-len(kinds) // step))]
    made = reduce(DataFrame.union, made).select("id", "x.b", "x.v", "path", "is_secret", "end")
    close = F.when(F.col("b").rlike("[\"']$"), F.right("b", F.lit(1))).otherwise("")
    return made.select(F.col("id").alias("doc_id"), F.concat("b", "v", close, "end").alias("text"), "path", F.length("b").cast("long").alias("start"), "is_secret")


def labelled_candidates(found: DataFrame, labelled: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``found`` with ``is_secret``, where ``labelled`` (id_col, start, is_secret) judges the candidate; null judgements are left out."""
    judged = labelled.where("is_secret is not null").groupBy(F.col(id_col).alias("_i"), F.col("start").alias("_s")).agg(F.max("is_secret").cast("int").alias("is_secret"))
    return found.join(judged, found["_id"].eqNullSafe(judged["_i"]) & (found["start"] == judged["_s"])).drop("_i", "_s")


def scan(docs: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", rows: int = MAX_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """(id_col, start, length, finding, score, is_secret) for every candidate. ``labelled``: (id_col, start, is_secret), findings that were judged; planted ones otherwise."""
    found = table(candidates(docs, id_col, text_col, path_col), "candidates")
    if labelled is None:
        made = table(planted(docs.sparkSession), "made")
        mine = table(candidates(made, path_col="path"), "planted")
        known, done = labelled_candidates(mine, made), [made, mine]
    else:
        known, done = labelled_candidates(found, labelled, id_col), []
    #: Each finding's text and surroundings once, so that copies of a document do not fill the sample.
    known = known.withColumn("_at", F.xxhash64("finding", "before")).dropDuplicates(["finding", "before", "after", "_path", "is_secret"]).orderBy("_at", "finding", "after", "_path", "is_secret").limit(rows)
    known = table(known, "known")
    words = dictionary(docs, found.select("finding").union(known.select("finding")), text_col)
    sample = table(describe(cover(known, words)).select("is_secret", *FEATURES).coalesce(1), "labelled")
    share = sample.agg(F.avg("is_secret"), F.count("*")).first()
    described = describe(cover(found, words))
    if not share[1] or share[0] in (0.0, 1.0):
        scored = described.withColumn("score", F.lit(float(share[0] or 0.0)))
    else:
        vectors = VectorAssembler(inputCols=FEATURES, outputCol="_v")
        forest = RandomForestClassifier(featuresCol="_v", labelCol="is_secret", numTrees=TREES, maxDepth=DEPTH, minInstancesPerNode=2, seed=17, probabilityCol="_prob", rawPredictionCol="_raw", predictionCol="_pred")
        model = forest.fit(vectors.transform(sample))
        scored = model.transform(vectors.transform(described)).withColumn("score", vector_to_array("_prob")[1])
    drop(known, sample, *done)
    return scored.select(F.col("_id").alias(id_col), "start", F.length("finding").cast("long").alias("length"), "finding", "score", F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int").alias("is_secret"))


def op1_secret_scan(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
