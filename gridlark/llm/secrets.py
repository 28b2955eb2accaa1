"""Secrets in text: candidates from patterns, and a random forest that takes false findings out again."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridlark.llm.common import materialize

TRAIN_ROWS = 6_000
CONTEXT = 48
CASES = 28
STRIDE = 256
MASK = "[SECRET]"

# Words and links before a value, what a candidate is made of, words that go with secrets and with other long strings, and common words in code.
_NAME = r"(?i:token|secret|passw|passphrase|pass|pwd|api.?key|access.?key|auth|bearer|credential|private)[A-Za-z0-9_.\-]{0,16}"
_LINK = _NAME + r"[^\w\s]{0,3}[ \t]{0,3}[=:>][=>]?\s{0,3}[\"'`]?"
_SAID = _NAME + r"[ \t]{1,2}(?i:is|was)[ \t]{1,2}[\"'`]?"
_FLAG = r"--[A-Za-z\-]{0,20}" + _NAME + r"[ \t]{1,2}[\"'`]?"
#: What stands before the value of a name that speaks for a secret. Short looks back come first: the long ones would cost too much at every sign.
_LEADS = rf"(?:(?<=[=:>]\s{{0,3}}[\"'`]?)(?<={_LINK})|(?<=(?i:is|was)[ \t]{{1,2}}[\"'`]?)(?<={_SAID})|(?<=[ \t][\"'`]?)(?<={_FLAG})|(?<=(?i:bearer|basic)[ \t]{{1,2}}))"
#: A value in quotes is all between them; another one ends at a space or quote, before a tag or the next name, without signs that end a sentence or bracket.
_OPEN = r"(?![\s\"'`])(?!(?i:bearer|basic|token)\s)[^\s\"'`]+?(?=[.,;)\]}]{0,3}(?:[\s\"'`]|\z|<[/A-Za-z!])|[,;&][A-Za-z_\-]{1,40}[=:])"
_VALUE = rf"(?:(?<=\")[^\"\r\n]++(?=\")|(?<=')[^'\r\n]++(?=')|(?<=`)[^`\r\n]++(?=`)|{_OPEN})"
_LOGIN = r"(?<=:)(?<=://[^\s/:@\"']{1,64}:)[^\s/@\"']++(?=@)"
_LONG = r"(?<![A-Za-z0-9+/_\-])(?!([A-Za-z0-9+/_\-])\1*+(?![A-Za-z0-9+/_\-]))[A-Za-z0-9+/_\-]{20,}+(?:={1,2}(?![A-Za-z0-9+/_=\"'\-]))?"
CANDIDATE = rf"{_LEADS}{_VALUE}|{_LOGIN}|{_LONG}"
#: What texts with candidates hold: one of the names, and then what may lead from it to a value; a long run; a login. These look forward only.
_NAMES = ("token", "secret", "pass", "pwd", "key", "auth", "bearer", "credential", "private", "basic")
_AHEAD = rf"(?:{_LINK}|{_SAID}|{_FLAG}|(?i:bearer|basic)[ \t])"
_RUN = r"(?<![A-Za-z0-9+/_\-])[A-Za-z0-9+/_\-]{20}"
PREFIXES = r"^(?:A[KS]IA[A-Z0-9]{16}|gh[pousr]_|github_pat_|[sr]k_live_|xox[abprs]-|glpat-|npm_|AIza)"
SECRET_WORDS = r"(?i)(token|secret|passw|passwd|pwd|api.?key|access.?key|auth|bearer|credential|private)"
OTHER_WORDS = r"(?i)(commit|sha\d*|md5|hash|digest|checksum|etag|revision|uuid|guid|isbn|serial|order|account|tracking)"
WORDS = r"(example|sample|test|demo|dummy|your|insert|change|placeholder|version|release|build|config|index|page|image|file|name|data|user|html|http|www|com|org|content|assets|static|download|article|title|default|the|and|for|with|tion|ing|ent|ver|ber)"
FEATURES = ["length", "changes", "digits", "upper", "hex", "distinct", "covered", "slashes", "path_before", "file_after", "secret_words", "other_words", "assigned", "quoted", "dashes", "longest_run", "other_signs", "prefix", "named", "name_itself", "plain_word"]


def share(c: Column, pattern: str) -> Column:
    """The share of a string's characters that matches of a pattern cover."""
    return (F.length(c) - F.length(F.regexp_replace(c, pattern, ""))) / F.greatest(F.length(c), F.lit(1))


def features() -> dict[str, Column]:
    """Of a finding's columns candidate, before and after: its length, how often the kind of character changes along it and the like, how much of it
    dictionary words cover, whether it is part of a path, and words and signs next to it."""
    c, before, after = F.col("candidate"), F.col("before"), F.col("after")
    kinds = F.translate(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[a-z]", "\u0001"), "[A-Z]", "\u0002"), "[0-9]", "\u0003"), "+/_=-", "\u0004\u0004\u0004\u0004\u0004")
    runs = F.length(F.regexp_replace(kinds, "(.)\\1*", "x"))
    near = F.right(before, F.lit(32))
    flag = lambda cond: F.when(cond, 1.0).otherwise(0.0)
    return {
        "length": F.length(c).cast("double"),
        "changes": runs / F.length(c),
        "digits": share(c, "[0-9]"),
        "upper": share(c, "[A-Z]"),
        "hex": flag(F.rlike(c, F.lit("^(?:[0-9a-f]+|[0-9A-F]+)$"))),
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / F.least(F.length(c), F.lit(40)),
        "covered": share(F.lower(c), WORDS),
        "slashes": F.regexp_count(c, F.lit("/")).cast("double"),
        "path_before": flag(F.rlike(before, F.lit(r"(?:://|[/\\.@?&])[^\s\"']*$"))),
        "file_after": flag(F.rlike(after, F.lit(r"^\.[A-Za-z]{2,4}\b"))),
        "secret_words": flag(F.rlike(near, F.lit(SECRET_WORDS))),
        "other_words": flag(F.rlike(near, F.lit(OTHER_WORDS))),
        "assigned": flag(F.rlike(before, F.lit(r"[=:][^A-Za-z0-9]{0,8}$"))),
        "quoted": flag(F.rlike(before, F.lit("[\"'`]$"))),
        "dashes": F.regexp_count(c, F.lit("[-_]")).cast("double"),
        "longest_run": F.coalesce(F.array_max(F.transform(F.regexp_extract_all(c, F.lit("[A-Za-z]+"), F.lit(0)), lambda x: F.length(x))), F.lit(0)).cast("double"),
        "other_signs": share(c, r"[^A-Za-z0-9+/_=\-]"),
        "prefix": flag(F.rlike(c, F.lit(PREFIXES))),
        "named": flag(F.rlike(before, F.lit(f"(?:{_LINK}|{_SAID}|{_FLAG}|(?i:bearer|basic)[ \\t]{{1,2}}|://[^\\s/:@]{{1,64}}:)$"))),
        "name_itself": flag(F.rlike(after, F.lit("^[\"'`]?[ \\t]{0,3}[=:]"))),
        "plain_word": flag(F.rlike(c, F.lit(r"^(?:[A-Z]?[a-z]+|[A-Z]+)$"))),
    }


def may_hold(text: str) -> Column:
    """Whether a text may hold a candidate. Most texts are settled by plain searches, which cost little beside CANDIDATE's looks back."""
    low = F.lower(text)
    named = F.lit(False)
    for name in _NAMES:
        named = named | F.contains(low, F.lit(name))
    login = F.contains(F.col(text), F.lit("://")) & F.rlike(text, F.lit(r"://[^\s/:@\"']{1,64}:"))
    return F.coalesce((named & F.rlike(text, F.lit(_AHEAD))) | F.rlike(text, F.lit(_RUN)) | login, F.lit(False))


def candidates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per candidate: key, ordinal (from 0), start (code units from 0), candidate, before, after.

    Candidates are runs of 20 or more letters, digits and +/_- (digits or not, but not one sign over and over), values of any length and
    signs that a secret word leads to, and passwords in URLs. Texts are cut at candidates; the parts between, and the candidate before, give
    position and neighbouring words, so text of any length is read whole and once. Null and empty texts have none.
    """
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text")).where(may_hold("text"))
    rows = rows.withColumn("found", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0))).where(F.size("found") > 0)
    rows = rows.withColumn("parts", F.split("text", CANDIDATE))
    rows = rows.withColumn("lengths", F.zip_with("parts", "found", lambda p, c: F.length(p) + F.coalesce(F.length(c), F.lit(0))))
    total = lambda first, n: F.aggregate(F.slice("lengths", first + 1, n), F.lit(0), lambda t, x: t + x)

    def one(c: Column, i: Column) -> Column:
        block = F.floor(i / STRIDE).cast("int")
        # The name of a value can be a candidate itself.
        last = F.right(F.get("parts", i), F.lit(CONTEXT))
        before = F.when(i > 0, F.concat(F.right(F.get("parts", i - 1), F.lit(CONTEXT)), F.right(F.get("found", i - 1), F.lit(CONTEXT)), last)).otherwise(last)
        start = F.coalesce(F.get("bases", block), F.lit(0)) + total(block * STRIDE, i - block * STRIDE) + F.length(F.get("parts", i))
        return F.struct(start.alias("start"), c.alias("candidate"), F.right(before, F.lit(CONTEXT)).alias("before"), F.left(F.get("parts", i + 1), F.lit(CONTEXT)).alias("after"))

    # lengths are summed in two levels, and only small structs leave the array: neither work nor memory is text times candidates
    blocks = F.sequence(F.lit(0), F.floor((F.size("found") - 1) / STRIDE).cast("int"))
    rows = rows.withColumn("bases", F.transform(blocks, lambda j: total(F.lit(0), j * STRIDE)))
    each = rows.select("key", F.posexplode(F.transform("found", one)).alias("ordinal", "c"))
    return each.select(F.col("key").alias(key), "ordinal", "c.start", "c.candidate", "c.before", "c.after")


def labelled(spark: SparkSession, rows: int = TRAIN_ROWS) -> DataFrame:
    """Labelled findings (candidate, before, after, label) in publicly documented formats, made by a rule, the same each time.

    Label 1: keys and tokens in assignments, headers and settings. Label 0: commits, digests, UUIDs, account and card numbers, paths, file
    names, words joined by signs, placeholders, names of settings, dull values of secret words, and random strings without a word that speaks for a
    secret.
    """
    i = F.col("id")
    pick = lambda *xs: F.element_at(F.array(*[F.lit(x) if isinstance(x, str) else x for x in xs]), (F.floor(i / CASES) % len(xs) + 1).cast("int"))
    cut = lambda c, n: F.substring(c, 1, n)
    cased = lambda c: F.when(F.floor(i / 7) % 4 == 0, F.upper(c)).otherwise(c)
    # parts that many cases share are columns, not expressions written out in each case: plans stay small
    seeds = spark.range(0, rows, 1, 1).withColumns({
        "hexed": F.sha2(F.concat(i.cast("string"), F.lit("a")), 256),
        "b64": F.translate(F.base64(F.unhex(F.sha2(F.concat(i.cast("string"), F.lit("b")), 512))), "\r\n", ""),
        "word": pick("token", "secret", "api_key", "access_key", "password", "auth", "TOKEN", "client_secret", "passwd", "credential", "private_key"),
        "noise": pick("", "!!", "###", "***", "$$$", "%%%", "&&&", ""),
        "glue": pick(" = \"", "=\"", ": \"", "=", ": ", " = '", " =\"", ":\""),
        "tail": pick("\"", "\" and the", "\";", " ", "\" |", "' ", "\"!!", "\","),
        "plain": pick("the order of things and ", "see page ", "of that for ", "und der auf ", "que de los ", "dans les ", "is with the "),
        "named": pick("commit ", "sha256: ", "md5 = \"", "checksum=", "etag: \"", "revision ", "hash: ", "digest = \""),
    })
    seeds = seeds.withColumns({"alnum": F.translate("b64", "+/=", "xY0"), "digits": F.translate("hexed", "abcdef", "012345")})
    seeds = seeds.withColumn("letters", F.translate("alnum", "0123456789", "QwErTyUiOp"))
    hexed, b64, word, noise, glue, tail, plain, named, alnum, digits, letters = (F.col(c) for c in seeds.columns[1:])
    words = F.concat(pick("release-notes", "example_file", "the-quick-brown-fox", "user/content/static", "article-title-index", "download/assets/image"), pick("-", "_", "/"), pick("version", "page", "data", "build"), cut(digits, 3), F.lit("-the-and-for-with"))
    uuid = F.concat_ws("-", cut(hexed, 8), F.substring(hexed, 9, 4), F.substring(hexed, 13, 4), F.substring(hexed, 17, 4), F.substring(hexed, 21, 12))
    holder = pick("your_api_key_goes_here_123", "xxxxxxxxxxxxxxxxxxxxxxxx1234", "EXAMPLE_TOKEN_CHANGE_ME_00", "insert-your-secret-here-0000", "test_test_test_test_test_1", "00000000000000000000000000")
    lead = F.concat(pick("password", "db_password", "DB_PASSWORD", "secret", "pwd", "passwd", "auth_token", "user.password", "passphrase", "api_key", "PASS"), glue)
    password = pick(
        F.concat(pick("S", "sun", "Ho", "tr0ub", "kX"), cut(alnum, 5), pick("!", "#", "$", "%", "@", "&", "^", "?", "*"), F.substring(alnum, 9, 4)), F.concat(pick("hunter", "dragon", "Winter", "letmein", "monkey"), cut(digits, 3)), cut(alnum, 12),
        F.concat(cut(letters, 4), pick("!", "_", "."), F.substring(letters, 9, 6)), cut(hexed, 16), F.concat(pick("Summer", "qwerty", "admin", "P@ss", "Secr"), cut(digits, 4), pick("!", "!!", "#", "$")), F.concat(cut(b64, 8), pick("%", "&", "~", "*", "!")),
    )
    dull = pick("None", "null", "true", "false", "required", "string", "the", "str", "********", "<your-password>", "${PASSWORD}", "$TOKEN", "os.environ[", "getpass()", "self.password", "process.env.TOKEN", "{{password}}", "changeme", "invalid", "is", "optional", "xxxx", "<token>", "request.form.get(", "config.secret", "your_password", "missing", "%s", "text", "a")
    named_key = F.concat(pick("AWS_", "MY_", "SERVICE_", "DATABASE_", "github_", "google_cloud_"), pick("SECRET_ACCESS_", "CONNECTION_", "PRODUCTION_CLIENT_", "DEPLOYMENT_", "oauth_client_"), pick("KEY", "PASSWORD", "TOKEN_VALUE", "SECRET", "credentials"))
    joined = pick("release-notes-and-changes", "AbstractSingletonProxyFactoryBean", "the-quick-brown-fox-jumps", "user/content/static/pictures", "Donaudampfschifffahrtsgesellschaft", "MAXIMUM_NUMBER_OF_RETRIES", "getElementsByClassName", "article_title_index_page", "internationalization", "InternalServerErrorException", "and/or/either/neither/both", "counterrevolutionaries", "Aufmerksamkeitsdefizit", "XMLHttpRequestEventTarget", "DEFAULT_CONNECTION_TIMEOUT", "responsabilidades-compartidas", "well-known-and-well-loved-songs")
    cases = [
        (1, cased(cut(hexed, 40)), F.concat(word, noise, glue), tail),
        (1, cased(cut(hexed, 32)), F.concat(word, glue), tail),
        (1, cut(alnum, 40), F.concat(word, noise, glue), tail),
        (1, F.concat(pick("ghp_", "gho_", "sk_live_", "xoxb-", "glpat-", "npm_"), cut(alnum, 36)), F.concat(word, glue), tail),
        (1, F.concat(F.lit("AKIA"), F.upper(cut(alnum, 20))), F.concat(pick("aws ", "key ", "access_key = \"", ""), F.lit("")), tail),
        (1, cut(b64, 64), F.concat(F.lit("Authorization: Bearer "), F.lit("")), tail),
        (1, F.concat(pick("ghp_", "sk_live_", "glpat-"), cut(alnum, 36)), F.concat(plain, F.lit("")), F.lit(" and")),
        (1, cased(cut(hexed, 64)), F.concat(word, noise, glue), tail),
        (0, cut(hexed, 40), F.concat(named, F.lit("")), F.lit(" and")),
        (0, cut(hexed, 32), F.concat(named, F.lit("")), F.lit("\" the")),
        (0, uuid, F.concat(pick("id = \"", "uuid: ", "guid ", "id="), F.lit("")), tail),
        (0, F.concat(words), F.concat(pick("https://example.org/", "/usr/share/", plain, "src/", "href=\"/"), F.lit("")), pick(".html", " and", ".png", "/")),
        (0, holder, F.concat(word, glue), tail),
        (0, cut(digits, 24), F.concat(pick("account ", "order ", "tracking ", "serial: ", plain), F.lit("")), F.lit(" the")),
        (0, cut(alnum, 28), F.concat(pick("https://example.com/v?id=", "https://example.net/", "<img src=\"/static/"), F.lit("")), pick(".png", "&page=2", "/")),
        (0, cut(hexed, 64), F.concat(plain, F.lit("")), F.lit(" and the")),
        (1, F.concat(F.lit("AKIA"), F.upper(cut(letters, 16))), pick("aws ", "key ", "AWS_ACCESS_KEY_ID=", "access_key = \"", plain, ""), tail),
        (1, cut(letters, 40), F.concat(word, glue), tail),
        (1, pick(cut(alnum, 32), cut(hexed, 32), cut(letters, 24), cut(b64, 40)), F.concat(pick("https://api.example.com/v1?", "https://example.net/a/b?page=2&", "GET /v2/items?"), pick("api_key=", "token=", "access_token=", "apikey=", "auth=")), pick("&page=2", " and", "\"", "&user=x")),
        (1, pick(cut(b64, 40), cut(alnum, 40), cut(letters, 40)), pick("export AWS_SECRET_ACCESS_KEY=", "AWS_SECRET_ACCESS_KEY=", "GITHUB_TOKEN=", "DB_PASSWORD=", "CLIENT_SECRET: "), pick(" ", " and", "")),
        (1, password, lead, tail),
        (0, dull, lead, pick(" ", ")", " and", ";", ",")),
        (0, named_key, pick("export ", "", plain, "set ", "env."), pick("=", " = \"", ": ", "=\"", "=abc")),
        (0, F.concat(joined, pick("-", "_", "/"), pick("version", "page", "data", "build", "garden", "winter"), pick("-the-and-for-with", "/of/all/things", "_in_the_middle")), pick("https://example.org/", "/usr/share/", plain, "src/", "href=\"/", "see "), pick(".html", " and", ".png", "/", "")),
        (0, joined, pick("", plain, "class ", "see ", "id=\"", "import "), pick(" and", "(", ".", "\"", ",")),
        (0, cut(hexed, 40), F.concat(named, F.lit("")), pick("", ".", "\n")),
        (0, cut(alnum, 28), pick("https://example.com/v?id=", "https://example.net/a?page=2&ref=", "<a href=\"/w?v=", "?q="), pick("&page=2", " and", "\"")),
        (0, pick(cut(hexed, 40), cut(digits, 30), cut(hexed, 64)), pick("commit=", "sha=", "id=", "order=", "digest=", "etag=", "v=", "rev="), pick(" and", "&page=2", "\"", "")),
    ]
    assert len(cases) == CASES
    made = F.lit(None)
    for k in reversed(range(len(cases))):
        y, c, before, after = cases[k]
        made = F.when(i % len(cases) == k, F.struct(F.lit(float(y)).alias("label"), c.alias("candidate"), F.concat(plain, before).alias("before"), F.concat(after, F.lit(" ")).alias("after"))).otherwise(made)
    return seeds.select(made.alias("m")).select("m.*")


def train(findings: DataFrame, trees: int = 24, depth: int = 7, seed: int = 7) -> PipelineModel:
    """A forest over FEATURES from labelled findings (candidate, before, after, label); at most TRAIN_ROWS of them come from labelled()."""
    # findings are written down before features, whose expressions would else repeat the ones that make them many times over
    findings = materialize(findings.sparkSession, findings, "labelled")
    assemble = VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep")
    rows = assemble.transform(findings.withColumns(features())).select("features", "label")
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt", subsamplingRate=0.8)
    return PipelineModel([assemble, forest.fit(rows)])


def find_secrets(df: DataFrame, model: PipelineModel, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per candidate in df's texts: key, ordinal, start, length, candidate, fingerprint (SHA-256), score and is_secret.

    score is the forest's share for label 1; candidates under the threshold are false findings and stay in the result with is_secret false. Null
    and empty texts, and texts without a candidate, give no rows; repeated rows and null keys give rows each. Other columns aren't read. No shuffle
    and no Python: expressions and a forest in the JVM.
    """
    return scored(candidates(df, key, text), model, key, threshold)


def scored(held: DataFrame, model: PipelineModel, key: str, threshold: float) -> DataFrame:
    """find_secrets for candidates()."""
    probable = model.transform(held.withColumns(features()))
    score = F.round(vector_to_array("probability")[1], 6)
    return probable.select(key, "ordinal", "start", F.length("candidate").alias("length"), "candidate", F.sha2("candidate", 256).alias("fingerprint"), score.alias("score"), (score >= threshold).alias("is_secret"))


def redact(df: DataFrame, model: PipelineModel, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """df with every secret in its text replaced by MASK, and n_secrets (how many were); all rows stay, texts without secrets as they were.

    Candidates that are secrets are masked wherever they stand in the texts of their key, the longest first, so that one that is part of another leaves nothing of
    that behind (those of less than 20 signs where no letter or digit is next to them); repeated rows of a key are redacted alike.
    Only rows that may hold a candidate are shuffled, to be joined with their findings; all others pass through. A row with a null key is redacted by its own
    findings alone. Null and empty texts stay as they are. A column n_secrets of df is replaced.
    """
    kept = df.select(*[c for c in df.columns if c != "n_secrets"])
    has = may_hold(text)
    told = kept.withColumn("_key", F.when(F.col(key).isNotNull(), F.concat(F.lit("k"), F.col(key).cast("string"))).otherwise(F.concat(F.lit("t"), F.sha2(text, 256))))
    # written down, so that the features and the forest aren't part of one plan with what makes the candidates and with the join
    held = materialize(df.sparkSession, candidates(told.where(has).select("_key", text), "_key", text), "candidates")
    found = scored(held, model, "_key", threshold).where("is_secret")
    per = found.groupBy("_key").agg(F.array_sort(F.collect_set(F.struct((-F.col("length")).alias("n"), "candidate"))).alias("_found"))
    joined = told.where(has).join(per, "_key", "left")
    texts = F.transform(F.coalesce("_found", F.array().cast("array<struct<n:int,candidate:string>>")), lambda s: s["candidate"])
    whole = lambda s: F.concat(F.lit(r"(?<![A-Za-z0-9])\Q"), F.replace(s, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?![A-Za-z0-9])"))
    mask = lambda t, s: F.when(F.length(s) < 20, F.regexp_replace(t, whole(s), F.lit(MASK))).otherwise(F.replace(t, s, F.lit(MASK)))
    clean = F.aggregate(texts, F.col(text), mask)
    some = joined.select(*[clean.alias(c) if c == text else F.col(c) for c in kept.columns], F.coalesce(F.size("_found"), F.lit(0)).alias("n_secrets"))
    return kept.where(~has).withColumn("n_secrets", F.lit(0)).unionByName(some)
