"""Secret scans with a random forest that removes false positives. DataFrame functions only.

Candidates are long runs of key characters with digit and letter, whatever begins like a provider's key, and
whatever is assigned to a name that holds secrets. A forest trained on labelled findings judges each by its length,
character transitions, dictionary coverage, path and neighbouring words. The trees become SQL
expressions, so scoring is part of the scan of the texts: no shuffle, no join and no Python.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word parts that names and identifiers are made of.
DICTIONARY = (
    "about account action address admin align array asset async author backup base batch block border build bundle button cache change check class client "
    "cloud code collection color commit common component config connection console content context control copy core count create data database date debug default "
    "delete demo detail device dialog docs document domain download driver dummy edit element email enable entity error event example export extension factory "
    "feature field file filter fixture folder font footer form format frame function gateway global graph group handler header height home host icon image "
    "import index info input install instance internal item json label language layout letter level library license link list local location login loop main "
    "manager master member memory menu merge message meta method metrics middle mobile mock model module month name network node normal note number object offset "
    "option order output package page parent part party password patch path pattern people performance person placeholder platform player plugin point policy "
    "position post price primary process product profile program project property provider proxy public query queue random range read record reference release "
    "remote report request reset resource response result return role root route sample schema screen script search secret section select sequence server service "
    "session setting share signature size source stack stage standard start state static status stock storage store stream string style system table tag target "
    "task team template test text theme thing ticket time title token tool topic total track transfer tree type unit update upload user util valid value "
    "vendor version video view virtual visit volume warning week width widget window word work world writer year your change-me changeme"
)
#: The beginnings of keys that providers issue.
PREFIXES = "AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|glpat-|xoxb-|xoxp-|sk_live_|sk-|rk_live_|AIza|ya29|eyJ|SG_|npm_|pypi-|hf_"

SPACES = r"[ \t\n\x0B\f\r]+"
CANDIDATE = r"[A-Za-z0-9+/_\-]{12,}={0,2}"
_NAMES_SECRET = r"(?i)passw|passwd|(?<![a-z])pass(?![a-z])|pwd|secret|token|api.?key|access.?key|private|credential|auth|bearer|client.?key|\bkey\b"
_NAMES_DIGEST = r"(?i)sha\d*|md5|hash|digest|checksum|commit|revision|etag|integrity|uuid|guid|blob|version|build|\bid\b"
_TEST_PATH = r"(?i)test|spec|fixture|example|sample|mock|demo|doc"

#: Strings that begin like a provider's key; single dots inside belong to them.
KEYED = rf"(?<![A-Za-z0-9])(?:{PREFIXES})(?:[A-Za-z0-9+/_\-]|\.[A-Za-z0-9])+={{0,2}}"
_NAME = rf"(?i:{_NAMES_SECRET.removeprefix('(?i)')})[\w.\-]*[\"'\])}}]*"
_GIVES = "[:=]{1,2}>?"
#: A quoted value, or one up to white space, quotes or the next assignment.
_GIVEN = r"""(?:"[^"]+"|'[^']+'|["']?(?:(?![,;&][A-Za-z_][\w.\-]*[=:])[^\s"'<>])+)"""
#: An assignment within a word, and one that white space divides.
INSIDE = f"({_NAME}{_GIVES})({_GIVEN})"
ACROSS = rf"^(\S*{_NAME} ?{_GIVES} ?)({_GIVEN})"
#: An assignment whose value begins with a quote, and one whose quote is closed.
_QUOTED = rf"^\S*{_NAME} ?{_GIVES} ?[\"']"
_CLOSED = rf"""^\S*{_NAME} ?{_GIVES} ?(?:"[^"]+"|'[^']+')"""
#: The password of an address, and what is shown as a bearer's token.
ADDRESS = r"([A-Za-z][A-Za-z0-9+.\-]*://[^\s/:@]*:)([^\s/@]+)@"
IN_ADDRESS = "://[^ ]*: password$"
BEARER = r"^(\S*(?i:bearer) )([A-Za-z0-9._~+/\-]{8,}=*)"
ANY_CANDIDATE = rf"{CANDIDATE}|{KEYED}|{_NAME}\s*[:=]|{ADDRESS}|(?i:bearer)\s"

FEATURES = ["length", "transitions", "letter_case", "dictionary", "digits", "distinct", "hex_only", "known_prefix", "secret_name", "digest_name", "test_path", "separators"]


@dataclass(frozen=True)
class SecretParameters:
    trees: int = 24
    depth: int = 6
    training_rows: int = 6000  # labelled findings that training reads at most
    threshold: float = 0.5
    seed: int = 11


def _dictionary() -> str:
    return "|".join(sorted(set(DICTIONARY.split()), key=lambda w: (-len(w), w)))


def feature_columns(value: Column, before: Column, after: Column, path: Column) -> dict[str, Column]:
    """The forest's inputs for a candidate, the words before it (with the name it is assigned to), the next word, and a path."""
    size = F.length(value).cast("double")
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    runs = F.size(F.regexp_extract_all(value, F.lit("[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+"), F.lit(0)))
    near = F.concat_ws(" ", before, after)
    return {
        "length": size,
        "transitions": (runs - 1) / size,
        "letter_case": F.least(F.length(F.regexp_replace(value, "[^A-Z]", "")), F.length(F.regexp_replace(value, "[^a-z]", ""))) / size,
        "dictionary": 1 - F.length(F.regexp_replace(F.lower(value), _dictionary(), "")) / size,
        "digits": F.length(F.regexp_replace(value, "[^0-9]", "")) / size,
        "distinct": F.size(F.array_distinct(F.split(value, ""))) / F.least(size, F.lit(24.0)),
        "hex_only": flag(value.rlike("^([0-9a-f]+|[0-9A-F]+)$")),
        "known_prefix": flag(value.rlike(f"^({PREFIXES})") | before.rlike(IN_ADDRESS)),
        "secret_name": flag(near.rlike(_NAMES_SECRET)),
        "digest_name": flag(near.rlike(_NAMES_DIGEST)),
        "test_path": flag(path.rlike(_TEST_PATH)),
        "separators": F.length(F.regexp_replace(value, "[^/_-]", "")) / size,
    }


def synthetic_findings(spark: SparkSession, rows: int = 6000) -> DataFrame:
    """Labelled findings (value, before, after, path, label) made by rule: keys of known shapes under names that
    hold secrets against digests, identifiers, paths, numbers, placeholders and test keys.

    For want of reviewed findings; ``train_forest`` takes those just as well.
    """
    df = spark.range(rows)
    draw = lambda k, n: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(n)).cast("int")
    pick = lambda k, words: F.element_at(F.array(*(F.lit(w) for w in words)), draw(k, len(words)) + 1)
    hexes = F.sha2(F.concat(F.lit("h"), F.col("id").cast("string")).cast("binary"), 256)
    base64 = F.regexp_replace(F.base64(F.unhex(F.sha2(F.concat(F.lit("b"), F.col("id").cast("string")).cast("binary"), 512))), "[=\n\r]", "")
    upper = F.translate(F.upper(base64), "+/01", "WXYZ")
    words = sorted(set(DICTIONARY.replace("-", "").split()))
    word = lambda k: pick(k, words)
    secret_names = ["password=", "passwd:", "secret =", "token = ", "api_key=", "apiKey:", "access_key =", "auth token", "client_secret:", "private key"]
    digest_names = ["sha256", "commit", "md5:", "digest =", "checksum", "revision", "etag:", "build", "uuid", "integrity ="]
    addresses = ["postgres://admin: password", "mysql://root: password", "https://user: password", "amqp://app: password", "redis://: password"]
    plain = ["the", "see", "und", "with", "for", "el", "les", "was", ""]
    letters = lambda start, n: F.translate(F.substring(hexes, F.lit(start), n), "0123456789abcdef", "bhrtkenousimlavd")
    prose = ["the", "is", "must", "required", "None", "null", "true", "string", "and", "unknown", "here", "see", "optional", "wrong", "John", "expired", "str", "not", "below", "missing"]
    number = lambda k: F.lpad(draw(k, 100000000).cast("string"), 8, "3")
    shapes = [
        (1, F.concat(F.lit("AKIA"), F.substring(upper, 1, 16)), pick(3, plain)),
        (1, F.concat(pick(4, ["ghp_", "glpat-", "sk_live_", "xoxb-", "AIza", "npm_"]), F.substring(base64, 3, 36)), pick(3, [*plain, *secret_names])),
        (1, F.substring(hexes, F.lit(7), draw(20, 25) + 12), pick(3, secret_names)),
        (1, F.substring(hexes, 1, 40), pick(3, secret_names)),
        (1, F.concat(F.substring(base64, 5, 20), F.substring(hexes, 3, 12)), pick(3, secret_names)),
        (1, F.substring(base64, 1, 32), pick(3, [*secret_names, *secret_names, *plain])),
        (0, F.substring(hexes, 1, 40), pick(3, [*digest_names, *plain])),
        (0, hexes, pick(3, [*digest_names, *plain])),
        (0, F.concat_ws("-", F.substring(hexes, 1, 8), F.substring(hexes, 9, 4), F.substring(hexes, 13, 4), F.substring(hexes, 17, 4), F.substring(hexes, 21, 12)), pick(3, [*digest_names, *plain])),
        (0, F.concat(word(5), F.lit("_"), word(6), F.lit("_"), word(7), draw(8, 100).cast("string")), pick(3, [*plain, *secret_names])),
        (0, F.concat(F.lit("/"), word(5), F.lit("/"), word(6), draw(8, 10).cast("string"), F.lit("/"), word(7)), pick(3, plain)),
        (0, F.concat(number(8), number(9)), pick(3, [*plain, *digest_names])),
        (0, F.concat(word(5), F.initcap(word(6)), F.initcap(word(7)), draw(8, 1000).cast("string")), pick(3, [*plain, *secret_names])),
        (0, F.concat(F.rpad(F.lit("x"), 12, "x"), draw(8, 100).cast("string")), pick(3, secret_names)),
        (0, F.concat(pick(4, ["your-", "example-", "dummy-", "changeme-", "test-"]), word(5), F.lit("-key-"), draw(8, 100).cast("string")), pick(3, secret_names)),
        (0, F.concat(word(5), F.lit("-2024-"), draw(8, 12).cast("string"), F.lit("-"), word(6)), pick(3, plain)),
        (1, F.concat(letters(3, draw(20, 5) + 4), draw(8, 1000).cast("string")), pick(3, secret_names)),
        (1, F.concat(letters(5, draw(20, 6) + 3), draw(8, 100).cast("string")), pick(3, secret_names)),
        (1, F.concat(F.substring(word(5), 1, 6), draw(8, 3000).cast("string")), pick(3, secret_names)),
        (1, F.concat(F.initcap(letters(3, draw(20, 4) + 1)), pick(4, ["@", "!", "#", "$", ".", "&"]), letters(12, draw(21, 5) + 2), pick(6, ["!", "?", "%", ""]), draw(8, 3000).cast("string")), pick(3, secret_names)),
        (1, F.concat(letters(3, draw(20, 5) + 4), pick(4, ["", "", " ", "-"]), letters(20, draw(21, 5) + 4), pick(4, ["", "", " ", "-"]), letters(40, draw(22, 9) + 4)), pick(3, secret_names)),
        (1, F.substring(F.concat(number(8), number(9), number(15)), F.lit(1), draw(20, 19) + 6), pick(3, secret_names)),
        (1, F.concat(F.lit("AKIA"), F.substring(F.translate(upper, "0123456789", "QWERTZUIOP"), 1, 16)), pick(3, [*plain, *secret_names])),
        (1, F.concat(F.substring(word(5), 1, 6), draw(8, 100).cast("string"), F.initcap(word(6)), draw(9, 100).cast("string")), pick(3, addresses)),
        (1, F.concat(letters(3, draw(20, 6) + 3), draw(8, 1000).cast("string")), pick(3, addresses)),
        (0, pick(4, prose), pick(3, secret_names)),
        (0, F.concat(word(5), pick(4, ["", "", "s", "()", ".", "_"]), pick(6, ["", "", *words])), pick(3, secret_names)),
        (0, F.concat(pick(4, ["${", "self.", "<", "os.environ[", "{{", "get_", "%("]), word(5), pick(6, ["}", "()", "]", "}}", ")s"])), pick(3, secret_names)),
        (0, F.concat(pick(4, ["sk-", "hf_", "eyJ", "npm_", "SG_"]), F.substring(word(5), 1, 4)), pick(3, plain)),
    ]
    kind = F.pmod(F.col("id"), F.lit(len(shapes)))
    label, value, before = F.lit(None).cast("double"), F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, (truth, shape, name) in enumerate(shapes):
        label, value, before = (F.when(kind == k, x).otherwise(y) for x, y in ((F.lit(float(truth)), label), (shape, value), (name, before)))
    test = draw(12, 10) == 0  # keys under a test path are made up
    path = F.when(test, "tests/fixtures/keys.py").otherwise(pick(13, ["src/app.py", "config/prod.yml", "src3", "notes.md", ""]))
    return df.select(value.alias("value"), before.alias("before"), pick(14, ["", "and", "the", ";", "of"]).alias("after"), path.alias("path"), F.when(test, 0.0).otherwise(label).alias("label"))


def train_forest(findings: DataFrame, p: SecretParameters = SecretParameters()) -> list:
    """Trees of a random forest over labelled findings (value, before, after, path, label); nodes as nested tuples.

    At most ``training_rows`` findings are read, those with the smallest hashes.
    """
    rows = findings.where("value is not null and label is not null").select(*(c.alias(n) for n, c in feature_columns(F.col("value"), F.col("before"), F.col("after"), F.col("path")).items()), F.col("label").cast("double").alias("label"))
    sample = rows.orderBy(F.xxhash64(*FEATURES), "label").limit(p.training_rows).persist()
    if not sample.where("label = 1").take(1) or not sample.where("label = 0").take(1):
        raise ValueError("labelled findings of both kinds are needed")
    data = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(sample).select("features", "label")
    model = RandomForestClassifier(numTrees=p.trees, maxDepth=p.depth, seed=p.seed, featureSubsetStrategy="sqrt", minInstancesPerNode=5).fit(data)

    def node(n):
        if "LeafNode" in n.getClass().getName():
            stats = list(n.impurityStats().stats())
            return stats[1] / sum(stats)
        return n.split().featureIndex(), n.split().threshold(), node(n.leftChild()), node(n.rightChild())

    sample.unpersist()
    return [node(t._call_java("rootNode")) for t in model.trees]


_TRAINED: dict[SecretParameters, list] = {}


def default_forest(spark: SparkSession, p: SecretParameters = SecretParameters()) -> list:
    """The forest of ``synthetic_findings``, trained once a process; it depends on ``p`` alone."""
    if p not in _TRAINED:
        _TRAINED[p] = train_forest(synthetic_findings(spark, p.training_rows), p)
    return _TRAINED[p]


def forest_sql(trees: list, features: str = "") -> str:
    """The mean of the trees' chances as SQL over feature columns, or over the fields of ``features``."""

    def sql(n) -> str:
        return f"{float(n)!r}D" if not isinstance(n, tuple) else f"IF({features}{FEATURES[n[0]]} <= {float(n[1])!r}D, {sql(n[2])}, {sql(n[3])})"

    return f"(({' + '.join(sql(t) for t in trees)}) / {len(trees)}.0D)"


def _literal(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def candidates_sql(words: str) -> str:
    """SQL for an array of (kind, word, value, before, after) over an array of words.

    Kind 0: runs of key characters with digit and letter. 1: other strings that begin like a provider's key. 2: other
    values right after a name that holds secrets and = or :, with or without white space between; a quoted one may have blanks;
    the password of an address and the word after ``Bearer``, which count as named so, whatever kind they are besides.
    """
    run, keyed, inside, across, address, bearer = (_literal(x) for x in (CANDIDATE, KEYED, INSIDE, ACROSS, ADDRESS, BEARER))
    names, bare = _literal(_NAMES_SECRET), _literal("""^["'].*["']$""")
    opened, ends = _literal("""[:=]>? ?["'][^"']*$"""), _literal(r"""^["']+|["',;.)\]}]+$""")
    runs = lambda i: f"filter(regexp_extract_all(get({words}, {i}), {run}, 0), v -> v rlike '[0-9]' and v rlike '[A-Za-z]')"
    keys = lambda i: f"regexp_extract_all(get({words}, {i}), {keyed}, 0)"
    near = f"array_join(slice({words}, i + 1, 3), ' ')"
    more = lambda n: f"array_join(slice({words}, i + 1, {n}), ' ')"
    quoted, closed = _literal(_QUOTED), _literal(_CLOSED)
    # most quotes close soon; only one that doesn't is looked for in all the rest
    tail = f"if({near} rlike {opened} and {near} rlike {quoted}, if({more(64)} rlike {closed}, {more(64)}, {more(f'size({words})')}), {near})"
    matches = f"""concat(
        transform(regexp_extract_all({words}[i], {inside}, 0), m -> struct(regexp_extract(m, {inside}, 1) as name, regexp_extract(m, {inside}, 2) as given)),
        filter(transform(array({tail}), t -> struct(regexp_extract(t, {across}, 1) as name, regexp_extract(t, {across}, 2) as given)), m -> contains(m.name, ' ') or contains(m.given, ' ')))"""
    other = f"""concat(
        transform(regexp_extract_all({words}[i], {address}, 0), m -> struct(regexp_extract(m, {address}, 1) as name, regexp_extract(m, {address}, 2) as v)),
        filter(transform(array({more(2)}), t -> struct(regexp_extract(t, {bearer}, 1) as name, regexp_extract(t, {bearer}, 2) as v)), m -> m.v <> ''))"""
    stripped = f"transform({matches}, m -> struct(m.name as name, if(m.given rlike {bare}, substring(m.given, 2, length(m.given) - 2), regexp_replace(m.given, {ends}, '')) as v))"
    before = f"if(i > 1, {words}[i - 2], null), if(i > 0, {words}[i - 1], null)"
    found = lambda kind: f"v -> named_struct('kind', {kind}, 'word', i, 'value', v, 'before', concat_ws(' ', {before}, substring_index({words}[i], v, 1)), 'after', get({words}, i + 1))"
    at = "i + length(m.name) - length(replace(m.name, ' ', ''))"
    given = f"""if(({words}[i] rlike '[:=]' or get({words}, i + 1) rlike '^[:=]') and {words}[i] rlike {names},
        transform(filter({stripped}, m -> m.v <> '' and not array_contains({runs(at)}, m.v) and not array_contains({keys(at)}, m.v)),
          m -> named_struct('kind', 2, 'word', {at}, 'value', m.v, 'before', concat_ws(' ', {before}, m.name), 'after', get({words}, {at} + size(split(m.v, ' '))))),
        array())"""
    shown = f"""if({words}[i] rlike '://' or {words}[i] rlike '(?i)bearer$',
        transform({other}, m -> named_struct('kind', 2, 'word', {at}, 'value', m.v, 'before', concat_ws(' ', {before}, m.name, 'password'), 'after', get({words}, {at} + 1))),
        array())"""
    return f"""
        flatten(transform(
          filter(sequence(0, size({words}) - 1), i -> ({words}[i] rlike {run} and {words}[i] rlike '[0-9]') or {words}[i] rlike {keyed}
            or (({words}[i] rlike '[:=]' or get({words}, i + 1) rlike '^[:=]') and {words}[i] rlike {names}) or {words}[i] rlike {address} or {words}[i] rlike '(?i)bearer$'),
          i -> concat(transform({runs('i')}, {found(0)}), transform(filter({keys('i')}, v -> not array_contains({runs('i')}, v)), {found(1)}), {given}, {shown})))
    """


def findings(docs: DataFrame, trees: list, p: SecretParameters = SecretParameters(), id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """One row per candidate: doc_id, finding (from 0), word (from 0), value, score, is_secret and the forest's inputs.

    Words are what ASCII white space separates. Null and empty texts have no rows; a null path is no test path.
    Repeated rows give repeated findings; null ids come back null. An empty table gives an empty result;
    other columns are ignored.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("_text"), F.col(path_col).cast("string").alias("_path"))
    hit = own.where(F.col("_text").rlike(ANY_CANDIDATE)).select("doc_id", "_path", F.split("_text", SPACES).alias("_words"))
    rows = hit.select("doc_id", "_path", F.posexplode(F.expr(candidates_sql("_words"))).alias("finding", "c"))
    flat = rows.select("doc_id", "finding", F.col("c.word").alias("word"), F.col("c.value").alias("value"), *(c.alias(n) for n, c in feature_columns(F.col("c.value"), F.col("c.before"), F.col("c.after"), F.col("_path")).items()))
    return flat.withColumn("score", F.expr(forest_sql(trees))).withColumn("is_secret", F.col("score") >= p.threshold)


def redact(docs: DataFrame, trees: list, p: SecretParameters = SecretParameters(), text_col: str = "text", path_col: str = "source", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret of ``text_col`` replaced by ``mark``; all rows and columns stay, in one pass.

    A value goes only from the words where the forest judged it a secret, the longest ones of a word first; the same
    string elsewhere, judged a digest, stays. A quoted value with blanks goes from each word that it spans. Texts without
    a candidate, null and empty texts are not touched; a null path is no test path; repeated rows are redacted alike; an
    empty table gives an empty result.
    """
    held, words, starts = "_candidates", "_words", "_starts"
    while {held, words, starts} & set(docs.columns):
        held, words, starts = "_" + held, "_" + words, "_" + starts
    text, path = F.col(f"`{text_col}`"), F.col(f"`{path_col}`").cast("string")
    hit = F.coalesce(text.cast("string").rlike(ANY_CANDIDATE), F.lit(False))
    # else the optimizer, say for a filter on the new text, would put these inside each other, to be evaluated word by word
    once = lambda c: F.when(F.spark_partition_id() >= 0, c)
    step = docs.withColumn(words, once(F.when(hit, F.split(text, SPACES))))
    step = step.withColumn(held, once(F.when(F.col(words).isNotNull(), F.expr(candidates_sql(words)))))
    step = step.withColumn(held, once(F.transform(held, lambda c: F.struct(c["word"].alias("word"), c["value"].alias("value"), *(f.alias(n) for n, f in feature_columns(c["value"], c["before"], c["after"], path).items())))))
    # (word, the part of a value in it, what takes its place): the first word of a value gets the mark
    step = step.withColumn(held, once(F.expr(f"""array_sort(flatten(transform(filter({held}, x -> {forest_sql(trees, 'x.')} >= {p.threshold!r}D),
        x -> transform(split(x.value, ' '), (v, k) -> struct(x.word + k as word, -length(v) as n, v as v, if(k = 0, {_literal(mark)}, '') as into)))))""")))
    # where each word's pieces begin in the sorted list, and how many they are, as an array over the words
    first = f"filter(transform({held}, (x, k) -> if(k = 0 or {held}[k - 1].word <> x.word, k, null)), k -> k is not null)"
    step = step.withColumn(starts, once(F.expr(first)))
    runs = f"""transform({starts}, (k, j) -> struct(k as at, coalesce(get({starts}, j + 1), size({held})) - k as n))"""
    step = step.withColumn(starts, once(F.expr(runs)))
    before = f"if(j = 0, -1, {held}[{starts}[j - 1].at].word)"
    by_word = f"flatten(transform({starts}, (r, j) -> concat(array_repeat(cast(null as struct<at: int, n: int>), {held}[r.at].word - {before} - 1), array(r))))"
    step = step.withColumn(starts, once(F.expr(f"if(size({starts}) > 0, {by_word}, null)")))
    pieces = f"slice({held}, r.at + 1, r.n)"
    clean = f"if(r is null, struct(w as w, false as joined), struct(aggregate({pieces}, w, (t, x) -> replace(t, x.v, x.into)) as w, exists({pieces}, x -> x.into = '') as joined))"
    gaps = f"concat(array(''), regexp_extract_all(`{text_col}`, {_literal(SPACES)}, 0))"
    rebuilt = F.expr(f"array_join(zip_with(zip_with({words}, {starts}, (w, r) -> {clean}), {gaps}, (c, g) -> concat(if(c.joined, '', coalesce(g, '')), c.w)), '')")
    return step.withColumn(text_col, F.when(F.size(held) > 0, rebuilt).otherwise(text)).select(*(F.col(f"`{c}`") for c in docs.columns))
