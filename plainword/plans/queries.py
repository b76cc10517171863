"""Registered queries over the operators, and the SQL that gives the same rows.

Words are word tokens of documents and conversations, taken without collapsing repeated letters where SQL has to follow (its patterns have no back-references)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import strings as S
from ..functions.tweet_tokens import tweet_tokens
from ..operators import candidates, classifier, clean, context, langmodel, lexicon, nearness, normalise, ranking, similarity
from ..session import saved
from ..sources import readers
from . import jobs
from .config import Config

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _tokens(df: DataFrame, *ids: str) -> DataFrame:
    return df.select(*ids, S.word_tokens(F.coalesce("text", F.lit("")), collapse=False).alias("tokens"))


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, tokens of all documents."""
    return _tokens(table(spark, sf, "documents"), "doc_id")


def conversations(spark: SparkSession, sf: str) -> DataFrame:
    return _tokens(table(spark, sf, "conversations"), "conv_id", "turn")


def benchmark(spark: SparkSession, sf: str) -> DataFrame:
    return _tokens(table(spark, sf, "benchmark"), "item_id")


CONV = ["conv_id", "turn"]
#: Times a word has to occur to be in the dictionary, and in the smaller one that candidates come from.
KNOWN, COMMON, RARE = 5, 30, 20


def _counts(spark: SparkSession, sf: str) -> DataFrame:
    return lexicon.word_count(documents(spark, sf), F.col("tokens"))


def _known(counts: DataFrame, least: int = KNOWN) -> DataFrame:
    return lexicon.dictionary(counts.filter(F.col("freq") >= least))


def dictionary(spark: SparkSession, sf: str, least: int = KNOWN) -> DataFrame:
    return saved(_known(_counts(spark, sf), least), "dictionary")


def _saved_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The counts of ``_counts``, made once for all that a query takes from them."""
    return saved(_counts(spark, sf), "counts")


_TOK = r"list_filter(list_transform(string_split(lower(coalesce(text, '')), ' '), lambda x: regexp_extract(x, '^[a-z][a-z\-'']*')), lambda x: x <> '')"
_WORD = r"^\d?[a-z]+[a-z0-9]*'?[a-z]+$".replace("'", "''")
BASE = rf"""WITH docs AS (SELECT doc_id, {_TOK} AS tokens FROM documents),
conv AS (SELECT conv_id, turn, {_TOK} AS tokens FROM conversations),
bench AS (SELECT item_id, {_TOK} AS tokens FROM benchmark),
flat AS (SELECT conv_id, turn, unnest(range(len(tokens)))::INTEGER AS pos, unnest(tokens) AS tok FROM conv),
counts AS (SELECT word, count(*) AS freq FROM (SELECT unnest(tokens) AS word FROM docs) WHERE regexp_matches(word, '{_WORD}') GROUP BY word),
extra AS (SELECT unnest({list(lexicon.INCLUDED)}) AS word),
dict AS (SELECT word FROM counts WHERE freq >= {KNOWN} UNION SELECT word FROM extra),
common AS (SELECT word FROM counts WHERE freq >= {COMMON} UNION SELECT word FROM extra)
"""


@query(BASE + """, nmd AS (SELECT word AS oov, upper(word) AS iv FROM counts WHERE freq < 5 AND freq >= 2),
n AS (SELECT conv_id, turn, list(CASE WHEN d.word IS NULL THEN coalesce(iv, tok) ELSE tok END ORDER BY pos) AS t FROM flat LEFT JOIN dict d ON tok = d.word LEFT JOIN nmd ON tok = oov GROUP BY ALL)
SELECT conv_id, turn, array_to_string(conv.tokens, ' ') AS tokens, coalesce(array_to_string(t, ' '), '') AS norm_tokens FROM conv LEFT JOIN n USING (conv_id, turn)""")
def simple_normalise(spark, sf):
    counts = _saved_counts(spark, sf)
    mapping = counts.filter("freq < 5 AND freq >= 2").select(F.col("word").alias("oov"), F.upper("word").alias("iv"))
    out = normalise.simple_normalise(conversations(spark, sf), CONV, _known(counts), mapping)
    return out.select(*CONV, S.join_tokens(F.col("tokens")).alias("tokens"), S.join_tokens(F.col("norm_tokens")).alias("norm_tokens"))


@query(BASE + "SELECT word, freq FROM counts")
def word_count(spark, sf):
    return _counts(spark, sf)


@query(BASE + "SELECT word, freq FROM counts SEMI JOIN dict USING (word)")
def stratify_iv(spark, sf):
    counts = _saved_counts(spark, sf)
    return lexicon.stratify(counts, _known(counts)).filter("iv").select("word", "freq")


@query(BASE + f"SELECT word, freq FROM counts ANTI JOIN common USING (word) WHERE freq >= {RARE} AND length(word) >= 4")
def stratify_oov(spark, sf):
    return _oov(_saved_counts(spark, sf))


@query(BASE + "SELECT conv_id, turn, array_to_string(tokens, ' ') AS joined, len(tokens)::BIGINT AS n FROM conv")
def lower_join(spark, sf):
    return conversations(spark, sf).select(*CONV, S.join_tokens(F.col("tokens")).alias("joined"), F.size("tokens").cast("long").alias("n"))


@query(r"SELECT doc_id, md5(trim(regexp_replace(text, '[\s\p{Zs}]+', ' ', 'g'))) AS h FROM documents")
def squeeze_whitespace(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(S.squeeze_whitespace(F.col("text")).cast("binary")).alias("h"))


_WORD_PAIRS = "p AS (SELECT DISTINCT w FROM (SELECT unnest(string_split(lower(text), ' ')) AS w FROM benchmark) WHERE regexp_matches(w, '^[a-z]{3,9}$')), q AS (SELECT a.w AS a, b.w AS b FROM p a, p b WHERE a.w < b.w AND substr(a.w, 1, 3) = substr(b.w, 1, 3))"


def _word_pairs(spark, sf) -> DataFrame:
    """Pairs of different short words of the benchmark that begin with the same three letters."""
    w = table(spark, sf, "benchmark").select(F.explode(F.split(F.lower("text"), " ")).alias("w")).filter(F.col("w").rlike("^[a-z]{3,9}$")).distinct().withColumn("k", F.substring("w", 1, 3))
    return w.select(F.col("w").alias("a"), "k").join(w.select(F.col("w").alias("b"), "k"), "k").filter("a < b").select("a", "b")


@query(f"""WITH {_WORD_PAIRS}, f AS (SELECT w, i, j, substr(w, i, j - i + 1) AS s FROM p, range(1, 30) t(i), range(1, 30) u(j) WHERE i <= j AND j <= length(w))
SELECT a, b, levenshtein(a, b)::BIGINT AS lev,
  coalesce((SELECT max(i) FROM range(1, 30) t(i) WHERE i <= least(length(a), length(b)) AND substr(a, 1, i) = substr(b, 1, i)), 0)::BIGINT AS prefix,
  coalesce((SELECT max(i) FROM range(1, 30) t(i) WHERE i <= least(length(a), length(b)) AND right(a, i) = right(b, i)), 0)::BIGINT AS suffix FROM q""")
def string_metrics(spark, sf):
    a, b = F.col("a"), F.col("b")
    return _word_pairs(spark, sf).select("a", "b", S.levenshtein(a, b).cast("long").alias("lev"), S.common_prefix_length(a, b).cast("long").alias("prefix"), S.common_suffix_length(a, b).cast("long").alias("suffix"))


@query(f"""WITH RECURSIVE {_WORD_PAIRS}, d(a, b, i, r) AS (
  SELECT a, b, 0, list_transform(range(length(b) + 1), lambda x: 0) FROM q
  UNION ALL
  SELECT a, b, i + 1, list_reduce(list_transform(range(1, length(b) + 1), lambda j: [j::INTEGER]), lambda acc, x: list_append(acc, CASE WHEN substr(b, x[1], 1) = substr(a, i + 1, 1) THEN r[x[1]] + 1 ELSE greatest(acc[len(acc)], r[x[1] + 1]) END), [0]) FROM d WHERE i < length(a)
) SELECT a, b, r[len(r)]::BIGINT AS lcs FROM d WHERE i = length(a)""")
def lcs_pairs(spark, sf):
    return _word_pairs(spark, sf).select("a", "b", S.longest_common_subsequence(F.col("a"), F.col("b")).cast("long").alias("lcs"))


_SSK = """, pr AS (SELECT DISTINCT query, cand FROM pairs0), ws AS (SELECT query AS w FROM pr UNION SELECT cand FROM pr),
f AS (SELECT w, substr(w, i::INTEGER, 1) || substr(w, j::INTEGER, 1) AS f, sum(power(0.5, j - i + 1)) AS x FROM ws, range(1, 60) t(i), range(1, 60) u(j) WHERE i < j AND j <= length(w) GROUP BY ALL),
k AS (SELECT w, sum(x * x) AS k FROM f GROUP BY w), kk AS (SELECT query, cand, sum(a.x * b.x) AS k FROM pr JOIN f a ON a.w = query JOIN f b ON b.w = cand AND a.f = b.f GROUP BY ALL),
ssk AS (SELECT query, cand, coalesce(kk.k / sqrt(k1.k * k2.k), 0) AS ssk FROM pr LEFT JOIN kk USING (query, cand) LEFT JOIN k k1 ON k1.w = query LEFT JOIN k k2 ON k2.w = cand)
"""


@query(f"WITH {_WORD_PAIRS}, pairs0 AS (SELECT a AS query, b AS cand FROM q)" + _SSK + "SELECT query, cand, round(ssk, 6) AS ssk FROM ssk")
def ssk_pairs(spark, sf):
    return similarity.subsequence_kernel(_word_pairs(spark, sf).select(F.col("a").alias("query"), F.col("b").alias("cand"))).withColumn("ssk", F.round("ssk", 6))


@query()
def remove_repetition(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(S.remove_repetition(F.col("text")).cast("binary")).alias("h"))


def _punct_sql() -> str:
    x = "text"
    for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~":
        q = "''" if c == "'" else c
        x = f"regexp_replace({x}, '[{chr(92) if c in '[]^-' + chr(92) else ''}{q}]{{4,}}', '{(q if c != chr(92) else chr(92) * 2) * 3}', 'g')"
    return f"SELECT doc_id, md5({x}) AS h FROM documents"


@query(_punct_sql())
def remove_punct_repetition(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(S.remove_punct_repetition(F.col("text")).cast("binary")).alias("h"))


@query()
def tweet_tokenise(spark, sf):
    return table(spark, sf, "conversations").select(*CONV, S.join_tokens(tweet_tokens(F.col("text"))).alias("tokens"))


@query()
def html_unescape(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(S.html_unescape(F.col("html")).cast("binary")).alias("h"))


@query()
def word_tokenise(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(S.join_tokens(S.word_tokens(F.col("text"))).cast("binary")).alias("h"))


@query(BASE + "SELECT word, freq FROM counts WHERE starts_with(word, 'th')")
def trie_prefix(spark, sf):
    return lexicon.with_prefix(_counts(spark, sf), "th")


@query(BASE + "SELECT word, freq FROM counts WHERE ends_with(word, 'ing')")
def trie_suffix(spark, sf):
    return lexicon.with_suffix(_counts(spark, sf), "ing")


@query(BASE + "SELECT word, freq FROM counts WHERE contains(word, 'ent')")
def trie_substr(spark, sf):
    return lexicon.with_substring(_counts(spark, sf), "ent")


@query(BASE + "SELECT word, freq FROM counts WHERE word LIKE '%t%o%n%e%'")
def trie_subseq(spark, sf):
    return lexicon.with_characters(_counts(spark, sf), "tone")


@query(BASE + "SELECT p AS prefix, sum(freq)::BIGINT AS freq FROM counts, (SELECT unnest(['th', 'the', 'in', 'on', 'zz']) AS p) WHERE starts_with(word, p) GROUP BY p")
def prefix_freq(spark, sf):
    return lexicon.prefix_frequency(_counts(spark, sf), ["th", "the", "in", "on", "zz"])


def _lexicons(spark, sf) -> tuple[DataFrame, DataFrame]:
    a = _counts(spark, sf).select("word", "freq", F.array(F.lit("documents")).alias("data"))
    b = lexicon.word_count(benchmark(spark, sf), F.col("tokens")).select("word", "freq", F.when(F.length("word") > 4, F.array(F.lit("benchmark"))).alias("data"))
    return a, b


_LEX = BASE + f""", b AS (SELECT word, count(*) AS freq FROM (SELECT unnest(tokens) AS word FROM bench) WHERE regexp_matches(word, '{_WORD}') GROUP BY word),
j AS (SELECT coalesce(c.word, b.word) AS word, coalesce(c.freq, 0) + coalesce(b.freq, 0) AS freq, c.word IS NOT NULL AS x, b.word IS NOT NULL AND length(b.word) > 4 AS y FROM counts c FULL JOIN b ON c.word = b.word)
"""


@query(_LEX + "SELECT word, freq::BIGINT AS freq, CASE WHEN y THEN 'benchmark' WHEN x THEN 'documents' ELSE '' END AS data FROM j")
def lexicon_merge(spark, sf):
    return lexicon.merge(*_lexicons(spark, sf)).select("word", "freq", F.coalesce(F.array_join("data", ","), F.lit("")).alias("data"))


@query(_LEX + "SELECT word, freq::BIGINT AS freq, concat_ws(',', CASE WHEN x THEN 'documents' END, CASE WHEN y THEN 'benchmark' END) AS data FROM j")
def lexicon_merge_with(spark, sf):
    return lexicon.merge(*_lexicons(spark, sf), data=lexicon.union_data).select("word", "freq", F.array_join("data", ",").alias("data"))


@query(BASE + "SELECT word, freq FROM counts WHERE word <> 'the' UNION ALL SELECT word, freq + 3 FROM counts WHERE word = 'the' UNION ALL SELECT 'zzzz', 3")
def lexicon_insert(spark, sf):
    a, _ = _lexicons(spark, sf)
    return lexicon.insert(lexicon.insert(a, "zzzz", 3), "the", 3).select("word", "freq")


@query(BASE + "SELECT word, freq FROM counts WHERE word <> 'the'")
def lexicon_delete(spark, sf):
    return lexicon.delete(_counts(spark, sf), "the")


_OOV = BASE + f", oov AS (SELECT word, freq FROM counts ANTI JOIN common USING (word) WHERE freq >= {RARE} AND length(word) >= 4)"


def _oov(counts: DataFrame) -> DataFrame:
    return lexicon.frequent_oov(counts, _known(counts, COMMON), RARE, 4)


@query(_OOV + "SELECT o.word AS query, c.word AS cand, levenshtein(o.word, c.word)::INTEGER AS dist FROM oov o, common c WHERE levenshtein(o.word, c.word) <= 2")
def find_within(spark, sf):
    counts = _saved_counts(spark, sf)
    return candidates.find_within(_oov(counts), _known(counts, COMMON), 2)


@query(_OOV + """SELECT query, cand, dist::INTEGER AS dist, rank::INTEGER AS rank FROM (
SELECT o.word AS query, c.word AS cand, levenshtein(o.word, c.word) AS dist, row_number() OVER (PARTITION BY o.word ORDER BY levenshtein(o.word, c.word), c.freq DESC, c.word) AS rank
FROM oov o, counts c WHERE c.freq >= 30 AND levenshtein(o.word, c.word) <= 2) WHERE rank <= 3""")
def find_nearest(spark, sf):
    counts = _saved_counts(spark, sf)
    return candidates.find_nearest(_oov(counts), counts.filter(F.col("freq") >= COMMON), 3, 2)


def _spelt(counts: DataFrame) -> DataFrame:
    return candidates.confusion_set(_oov(counts), _known(counts, COMMON), None, 2)


@query(_OOV + "SELECT o.word AS query, c.word AS cand, 1 AS source FROM oov o, common c WHERE levenshtein(o.word, c.word) <= 2")
def confusion_lexical(spark, sf):
    return _spelt(_saved_counts(spark, sf))


@query()
def confusion_full(spark, sf):
    counts = _saved_counts(spark, sf)
    d = _known(counts, COMMON)
    return candidates.confusion_set(_oov(counts), d, candidates.phonetic_dictionary(d), 2, 1)


@query()
def dm_dict(spark, sf):
    return candidates.phonetic_dictionary(dictionary(spark, sf)).select("code", F.array_join("words", " ").alias("words"))


_CUT = _OOV + """, cs AS (SELECT o.word AS query, c.word AS cand, coalesce(n.freq, 0) AS freq FROM oov o, common c LEFT JOIN counts n ON n.word = c.word WHERE levenshtein(o.word, c.word) <= 2),
cut AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY freq DESC, cand) AS rank, count(*) OVER (PARTITION BY query) AS n FROM cs) WHERE rank <= n * 30 // 100)
"""


def _cut(counts: DataFrame) -> DataFrame:
    return candidates.cut(_spelt(counts), counts, 30)


@query(_CUT + "SELECT query, cand, freq, rank::INTEGER AS rank FROM cut")
def confusion_cut(spark, sf):
    return _cut(_saved_counts(spark, sf)).select("query", "cand", "freq", "rank")


def _positions(spark, sf) -> DataFrame:
    return conversations(spark, sf).select(*CONV, "tokens", F.posexplode("tokens").alias("pos", "tok"))


_POS = BASE + "SELECT conv_id, turn, p::INTEGER AS pos, array_to_string({}, ' ') AS ctx FROM (SELECT *, unnest(range(len(tokens))) AS p FROM conv)"


@query(_POS.format("tokens[greatest(p - 1, 1):p]"))
def context_left(spark, sf):
    return _positions(spark, sf).select(*CONV, "pos", S.join_tokens(S.context_left(F.col("tokens"), 2, F.col("pos"))).alias("ctx"))


@query(_POS.format("tokens[p + 2:p + 3]"))
def context_right(spark, sf):
    return _positions(spark, sf).select(*CONV, "pos", S.join_tokens(S.context_right(F.col("tokens"), 2, F.col("pos"))).alias("ctx"))


def _flat(spark, sf) -> DataFrame:
    return lexicon.exploded(conversations(spark, sf), CONV)


_NEAR = "SELECT a.conv_id, a.turn, a.pos, a.tok, (b.pos - a.pos)::INTEGER AS off, b.tok AS other FROM flat a JOIN flat b ON a.conv_id = b.conv_id AND a.turn = b.turn AND b.pos BETWEEN a.pos - {0} AND a.pos + {0} AND a.pos <> b.pos"


@query(BASE + _NEAR.format(2))
def indexed_context(spark, sf):
    return context.indexed_context(conversations(spark, sf), CONV, 2)


_GRAMS = "grams AS (SELECT conv_id, turn, p::INTEGER AS start, array_to_string(tokens[p + 1:p + 2], ' ') AS gram FROM (SELECT *, unnest(range(len(tokens) - 1)) AS p FROM conv))"


def _grams(spark, sf) -> DataFrame:
    return context.ngram_table(conversations(spark, sf), CONV, 2)


@query(BASE + ", " + _GRAMS + "SELECT * FROM grams")
def ngrams(spark, sf):
    return _grams(spark, sf).withColumn("gram", S.join_tokens(F.col("gram")))


@query(BASE + ", " + _GRAMS + """SELECT conv_id, turn, pos, tok, off::INTEGER AS off, gram FROM flat JOIN grams USING (conv_id, turn), (SELECT unnest([-2, -1, 1, 2]) AS off)
WHERE CASE WHEN off < 0 THEN start = pos - 1 + off ELSE start = pos + off END""")
def ngram_context(spark, sf):
    return context.ngram_context(conversations(spark, sf), S.joined_ngrams(F.col("tokens"), 2), CONV, 2, 2)


_UNIVERSE = _CUT + """, pairs AS (SELECT DISTINCT query, cand FROM cut), universe AS (SELECT query AS word FROM pairs UNION SELECT cand FROM pairs),
dflat AS (SELECT doc_id, unnest(range(len(tokens)))::INTEGER AS pos, unnest(tokens) AS tok FROM docs), known AS (SELECT * FROM dflat SEMI JOIN common ON word = tok),
g AS (SELECT doc_id, a.pos AS start, a.tok || ' ' || b.tok AS gram FROM known a JOIN known b USING (doc_id) WHERE b.pos = a.pos + 1),
off AS (SELECT unnest([-3, -2, -1, 1, 2, 3]) AS off), gg AS (SELECT doc_id, gram, off, CASE WHEN off < 0 THEN start + 1 - off ELSE start - off END AS pos FROM g, off),
cc AS (SELECT tok AS word, off::INTEGER AS off, gram, count(*) AS cnt FROM (SELECT * FROM dflat SEMI JOIN universe ON word = tok) JOIN gg USING (doc_id, pos) GROUP BY ALL)
"""


def _pairs(spark, sf, counts: DataFrame | None = None) -> DataFrame:
    return saved(_cut(_saved_counts(spark, sf) if counts is None else counts).select("query", "cand").distinct(), "pairs")


def _context_counts(spark, sf) -> DataFrame:
    counts = _saved_counts(spark, sf)
    return _counted(spark, sf, _pairs(spark, sf, counts), counts)


def _counted(spark, sf, p: DataFrame, counts: DataFrame) -> DataFrame:
    universe = p.select(F.col("query").alias("word")).union(p.select("cand")).distinct()
    return context.context_counts(documents(spark, sf), ["doc_id"], universe, _known(counts, COMMON))


@query(_UNIVERSE + "SELECT * FROM cc")
def context_counts(spark, sf):
    return _context_counts(spark, sf).withColumn("gram", S.join_tokens(F.col("gram")))


@query(_UNIVERSE + "SELECT off, gram, sum(cnt)::BIGINT AS total FROM cc GROUP BY off, gram")
def feature_totals(spark, sf):
    return context.feature_totals(_context_counts(spark, sf)).withColumn("gram", S.join_tokens(F.col("gram")))


_VALUES = {
    "cnt": "SELECT word, off, gram, cnt::DOUBLE AS x FROM cc",
    "prob": "SELECT word, off, gram, cnt::DOUBLE / sum(cnt) OVER (PARTITION BY word) AS x FROM cc",
    "mi": "SELECT word, off, gram, greatest(ln(cnt::DOUBLE * sum(cnt) OVER () / (sum(cnt) OVER (PARTITION BY word)::DOUBLE * sum(cnt) OVER (PARTITION BY off, gram))), 0) AS x FROM cc",
}
_SQL_MEASURES = {
    "cosine": ("cnt", "x * x", "x * y", "s / sqrt(a * b)"), "dice": ("cnt", "1.0::DOUBLE", "1.0::DOUBLE", "2 * s / (a + b)"), "jaccard": ("cnt", "1.0::DOUBLE", "1.0::DOUBLE", "s / (a + b - s)"),
    "overlap": ("cnt", "1.0::DOUBLE", "1.0::DOUBLE", "s / least(a, b)"), "tanimoto": ("cnt", "x * x", "x * y", "s / (a + b - s)"), "cosine_mi": ("mi", "x * x", "x * y", "s / sqrt(a * b)"),
    "dice_mi": ("mi", "x", "least(x, y)", "2 * s / (a + b)"), "jaccard_mi": ("mi", "x", "least(x, y)", "s / (a + b - s)"), "recall_mi": ("mi", "x", "x", "s / a"),
    "precision_recall_mi": ("mi", "x", "least(x, y)", "s / greatest(a, b)"), "lin": ("mi", "x", "x + y", "s / (a + b)"), "hindle": ("mi", "x", "least(x, y)", "s"),
    "lp": ("prob", "x * x", "x * y", "-sqrt(greatest(a + b - 2 * s, 0))"), "confusion": ("prob", "x", "x * y", "s"),
    "jensen": ("prob", "x", "x * log2(2 * x / (x + y)) + y * log2(2 * y / (x + y)) - x - y", "-(a + b + s) / 2"), "lee": ("prob", "x", "x * ln(x / (0.99 * y + 0.01 * x)) - x * ln(100)", "-(a * ln(100) + s)"),
}


def _similarity_sql(measure: str) -> str:
    value, own, both, result = _SQL_MEASURES[measure]
    return _UNIVERSE + f""", v AS ({_VALUES[value]}), n AS (SELECT word, sum({own}) AS n FROM v GROUP BY word),
    s AS (SELECT query, cand, sum({both}) AS s FROM pairs JOIN (SELECT word AS query, off, gram, x FROM v) USING (query) JOIN (SELECT word AS cand, off, gram, x AS y FROM v) USING (cand, off, gram) GROUP BY ALL),
    sim AS (SELECT query, cand, {result} AS score FROM (SELECT s.*, p.n AS a, q.n AS b FROM s JOIN n p ON p.word = query JOIN n q ON q.word = cand))
    """


def _near(spark, sf, measure: str) -> DataFrame:
    counts = _saved_counts(spark, sf)
    return nearness.similarity_in(documents(spark, sf), ["doc_id"], _pairs(spark, sf, counts), _known(counts, COMMON), measure)


def _register_similarities() -> None:
    for name in similarity.MEASURES:

        def run(spark, sf, name=name):
            return _near(spark, sf, name).select("query", "cand", (F.round("score", 6) + 0.0).alias("score"))

        run.__name__ = f"similarity_{name}"
        query(_similarity_sql(name) + "SELECT query, cand, round(score, 6) + 0.0 AS score FROM sim WHERE score IS NOT NULL AND NOT isnan(score)")(run)


_register_similarities()


@query(_similarity_sql("lin") + "SELECT query, (max({'s': round(score, 9), 'c': cand})).c AS cand FROM sim WHERE NOT isnan(score) GROUP BY query")
def best_pair(spark, sf):
    scored = _near(spark, sf, "lin").withColumn("score", F.round("score", 9))
    return similarity.best_pair(scored).select("query", "cand")


@query(_similarity_sql("lin") + ", pairs0 AS (SELECT query, (max({'s': round(score, 9), 'c': cand})).c AS cand FROM sim WHERE NOT isnan(score) GROUP BY query)" + _SSK + "SELECT query, cand, round(ssk, 6) AS ssk FROM ssk ORDER BY round(ssk, 9) DESC, query, cand LIMIT 20")
def ranked_pairs(spark, sf):
    return similarity.ranked_pairs(best_pair(spark, sf), 20).withColumn("ssk", F.round("ssk", 6))


@query("SELECT doc_id, length(text)::BIGINT AS n FROM documents WHERE lang = 'en'")
def clean_english(spark, sf):
    return clean.english(table(spark, sf, "documents"), lang="lang").select("doc_id", F.length("text").cast("long").alias("n"))


_DUP = rf"(SELECT doc_id, lang, list_transform({_TOK}, lambda x: left(x, 4)) AS k FROM documents)"


@query(f"SELECT min(doc_id) AS doc_id FROM {_DUP} WHERE len(k) >= 3 GROUP BY k")
def clean_duplicates(spark, sf):
    return clean.without_duplicates(table(spark, sf, "documents"), ["doc_id"], collapse=False).select("doc_id")


@query(f"SELECT min(doc_id) AS doc_id FROM {_DUP} WHERE len(k) >= 3 AND lang = 'en' GROUP BY k")
def clean_both(spark, sf):
    return clean.clean(table(spark, sf, "documents"), ["english", "duplicates"], english={"lang": "lang"}, duplicates={"order": ["doc_id"], "collapse": False}).select("doc_id")


@query(BASE + "SELECT conv_id, turn FROM conv WHERE NOT EXISTS (SELECT 1 FROM flat f WHERE f.conv_id = conv.conv_id AND f.turn = conv.turn AND tok NOT IN (SELECT word FROM dict))")
def clean_corpus(spark, sf):
    return clean.clean_corpus(conversations(spark, sf), CONV, dictionary(spark, sf)).select(*CONV)


_TRI = BASE + """, pad AS (SELECT ['<s>', '<s>'] || tokens || ['</s>'] AS t FROM docs WHERE len(tokens) > 0),
tri AS (SELECT t[i] AS a, t[i + 1] AS b, t[i + 2] AS c, count(*) AS n FROM (SELECT t, unnest(range(1, len(t) - 1)) AS i FROM pad) GROUP BY ALL),
bi AS (SELECT b, c, count(*) AS n FROM tri GROUP BY ALL), uni AS (SELECT c, count(*) AS n FROM bi GROUP BY c), p1 AS (SELECT c, n::DOUBLE / sum(n) OVER () AS p FROM uni),
h3 AS (SELECT a, b, sum(n) AS n, count(*) AS k FROM tri GROUP BY ALL), h2 AS (SELECT b, sum(n) AS n, count(*) AS k FROM bi GROUP BY b)
"""


def _model(spark, sf) -> langmodel.Model:
    return langmodel.train(documents(spark, sf))


@query(_TRI + "SELECT * FROM tri")
def trigram_counts(spark, sf):
    return langmodel.trigram_counts(documents(spark, sf))


@query(_TRI + "SELECT c, round(p, 9) AS p FROM p1")
def kn_unigram(spark, sf):
    return _model(spark, sf).unigrams.withColumn("p", F.round("p", 9))


_SCORE = """(SELECT a, b, c, ln(CASE WHEN h3.n IS NULL THEN p2 ELSE greatest(coalesce(tri.n, 0) - 0.75, 0) / h3.n + 0.75 * h3.k / h3.n * p2 END) AS logp FROM
(SELECT g.a, g.b, g.c, CASE WHEN h2.n IS NULL THEN coalesce(p, 1e-7) ELSE greatest(coalesce(bi.n, 0) - 0.75, 0) / h2.n + 0.75 * h2.k / h2.n * coalesce(p, 1e-7) END AS p2
FROM g LEFT JOIN p1 USING (c) LEFT JOIN bi USING (b, c) LEFT JOIN h2 USING (b)) LEFT JOIN tri USING (a, b, c) LEFT JOIN h3 USING (a, b))"""
_CPAD = "cp AS (SELECT ['<s>', '<s>'] || tokens || ['</s>'] AS t FROM conv WHERE len(tokens) > 0), g AS (SELECT DISTINCT t[i] AS a, t[i + 1] AS b, t[i + 2] AS c FROM (SELECT t, unnest(range(1, len(t) - 1)) AS i FROM cp))"


@query(_TRI + ", " + _CPAD + f"SELECT a, b, c, round(logp, 6) AS logp FROM {_SCORE}")
def kn_score(spark, sf):
    grams = langmodel.trigram_counts(conversations(spark, sf)).select("a", "b", "c")
    return langmodel.score_under(documents(spark, sf), grams).withColumn("logp", F.round("logp", 6))


@query()
def lm_rank(spark, sf):
    c = _pairs(spark, sf).select("query", "cand", F.lit("the").alias("left"), F.lit(None).cast("string").alias("right"))
    return langmodel.lm_ranked(c, _model(spark, sf), ["query"]).select("query", "cand", F.round("lm", 6).alias("lm"), "rank")


@query()
def read_raw(spark, sf):
    lines = table(spark, sf, "conversations").select(*CONV, F.col("text").alias("value"))
    return readers.parse_raw(lines).select(*CONV, "text", F.array_join("tokens", " ").alias("tokens"))


@query("SELECT conv_id, turn, array_to_string(t, ' ') AS text, len(t)::BIGINT AS n FROM (SELECT conv_id, turn, list_filter(string_split(lower(replace(text, ' ', chr(10))), chr(10)), lambda x: x <> '') AS t FROM conversations) WHERE len(t) > 0")
def read_tkn(spark, sf):
    records = table(spark, sf, "conversations").select(*CONV, F.replace("text", F.lit(" "), F.lit("\n")).alias("value"))
    return readers.parse_tkn(records).select(*CONV, "text", F.size("tokens").cast("long").alias("n"))


@query(BASE + "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN text ELSE array_to_string(tokens, ' ') END AS text, array_to_string(tokens, ' ') AS tokens FROM conversations JOIN conv USING (conv_id, turn)")
def read_json(spark, sf):
    c = table(spark, sf, "conversations")
    tokens = S.word_tokens(F.coalesce("text", F.lit("")), collapse=False)
    value = F.when(F.col("turn") % 2 == 0, F.to_json(F.struct("text"))).otherwise(F.to_json(F.struct(tokens.alias("tokens"))))
    return readers.parse_json(c.select(*CONV, value.alias("value")), lambda t: S.word_tokens(t, collapse=False)).select(*CONV, "text", F.array_join("tokens", " ").alias("tokens"))


@query("SELECT c_custkey AS c0, c_name AS c1, c_nationkey AS c2, c_mktsegment AS rest FROM customer")
def read_tsv(spark, sf):
    lines = table(spark, sf, "customer").select(F.concat_ws("\t", F.col("c_custkey").cast("string"), "c_name", F.col("c_nationkey").cast("string"), "c_mktsegment").alias("value"))
    return readers.parse_tsv(lines, ["long", "string", "int"], "rest").withColumn("rest", F.array_join("rest", "|"))


@query("SELECT event_id, (props->>'k')::BIGINT AS k FROM events")
def json_scalar(spark, sf):
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query(BASE + "SELECT conv_id, turn, array_to_string(tokens, ' ') AS value FROM conv")
def encode_raw(spark, sf):
    return conversations(spark, sf).select(*CONV, readers.encode("raw", F.col("tokens")).alias("value"))


@query(BASE + "SELECT conv_id, turn, array_to_string(list_transform(tokens, lambda x: x || chr(10)), '') AS value FROM conv")
def encode_tkn(spark, sf):
    return conversations(spark, sf).select(*CONV, readers.encode("tkn", F.col("tokens")).alias("value"))


@query(BASE + """SELECT conv_id, turn, '{"tokens":[' || array_to_string(list_transform(tokens, lambda x: '"' || x || '"'), ',') || ']}' AS value FROM conv""")
def encode_json(spark, sf):
    return conversations(spark, sf).select(*CONV, readers.encode("json", F.col("tokens")).alias("value"))


_CFLAT = BASE + ", pos AS (SELECT a.conv_id, a.turn, a.pos, b.tok AS gov, a.tok AS dep, (b.pos - a.pos)::INTEGER AS off FROM flat a JOIN flat b ON a.conv_id = b.conv_id AND a.turn = b.turn AND b.pos BETWEEN a.pos - 3 AND a.pos + 3 AND a.pos <> b.pos SEMI JOIN dict d ON d.word = b.tok)"


def _positives(spark, sf) -> DataFrame:
    return context.positive_features(conversations(spark, sf), CONV, dictionary(spark, sf))


@query(_CFLAT + "SELECT * FROM pos")
def positive_features(spark, sf):
    return _positives(spark, sf)


_NEG = _CUT.replace("WITH", "WITH", 1) + ", pos AS (" + _CFLAT.rpartition("pos AS (")[2] + ", neg AS (SELECT conv_id, turn, pos, gov, cand AS dep, off FROM pos JOIN (SELECT DISTINCT query, cand FROM cut) ON dep = query)"


@query(_NEG + "SELECT * FROM neg")
def negative_features(spark, sf):
    return context.negative_features(_positives(spark, sf), _pairs(spark, sf))


@query(_NEG + "SELECT true AS label, gov, dep, off FROM pos UNION ALL SELECT false, gov, dep, off FROM neg ANTI JOIN pos USING (gov, dep, off)")
def features_legit(spark, sf):
    p = _positives(spark, sf)
    return context.training_features(p, context.negative_features(p, _pairs(spark, sf)))


@query(_CFLAT + ", i AS (SELECT word, row_number() OVER (ORDER BY word) AS id FROM (SELECT gov AS word FROM pos UNION SELECT dep FROM pos)) SELECT conv_id, turn, pos, off, '1 1:0.5 ' || least(a.id, b.id) || ':1 ' || greatest(a.id, b.id) || ':1' AS line FROM pos JOIN i a ON a.word = gov JOIN i b ON b.word = dep")
def libsvm_encode(spark, sf):
    p = _positives(spark, sf)
    ids = saved(lexicon.unique_ids(p.select(F.col("gov").alias("word")).union(p.select("dep")), "word", 1), "word-ids")
    # All words have an id. A left join can't broadcast the contexts, which Spark takes for as small as the texts.
    met = p.join(ids.select(F.col("word").alias("gov"), F.col("id").alias("g")), "gov", "left").join(ids.select(F.col("word").alias("dep"), F.col("id").alias("d")), "dep", "left")
    return met.select(*CONV, "pos", "off", context.libsvm_line(F.lit(True), [F.col("g"), F.col("d")], F.lit(0.5)).alias("line"))


_BANK = "bank AS (SELECT gov, off, count(*)::DOUBLE / (SELECT count(*) FROM pos WHERE off > 0) AS score FROM pos WHERE off > 0 GROUP BY ALL)"


def _bank(p: DataFrame) -> DataFrame:
    from ..operators.depbank import dependency_frequency

    return dependency_frequency(p.filter("off > 0").select("gov", "off"))


@query(_CFLAT + ", " + _BANK + "SELECT gov, off, round(score, 9) AS score FROM bank")
def dependency_frequency(spark, sf):
    return _bank(_positives(spark, sf)).withColumn("score", F.round("score", 9))


@query(_CFLAT + ", " + _BANK + "SELECT conv_id, turn, pos, gov, dep, off, round(coalesce(score, 0), 9) AS score FROM pos LEFT JOIN bank USING (gov, off)")
def dependency_lookup(spark, sf):
    p = _positives(spark, sf)
    return context.with_dependency_score(p, _bank(p)).select(*CONV, "pos", "gov", "dep", "off", F.round("score", 9).alias("score"))


@query(BASE + ", n AS (SELECT conv_id, turn, tok, count(*) AS n FROM flat GROUP BY ALL), m AS (SELECT *, max(n) OVER (PARTITION BY conv_id, turn) AS m FROM n) SELECT conv_id, turn, CASE WHEN count(*) = 1 THEN min(tok) END AS tok FROM m WHERE n = m GROUP BY conv_id, turn")
def most_frequent(spark, sf):
    return ranking.most_frequent(_flat(spark, sf), CONV, "tok")


def _labels(spark, sf) -> DataFrame:
    return _flat(spark, sf).select(*CONV, F.col("tok").alias("cand"), F.when(F.length("tok") > 4, "pos").otherwise("neg").alias("pred"))


_VOTE = BASE + ", v AS (SELECT conv_id, turn, substr(tok, 1, 1) AS cand, CASE WHEN count(*) FILTER (length(tok) > 4) > count(*) FILTER (length(tok) <= 4) THEN 'pos' ELSE 'neg' END AS vote FROM flat GROUP BY ALL)"


def _votes(spark, sf) -> DataFrame:
    return ranking.predict_vote(_labels(spark, sf).withColumn("cand", F.substring("cand", 1, 1)), [*CONV, "cand"], "pred")


@query(_VOTE + "SELECT * FROM v")
def predict_vote(spark, sf):
    return _votes(spark, sf)


@query(_VOTE + "SELECT conv_id, turn, count(*) FILTER (vote = 'pos') >= 3 AS ill FROM v GROUP BY ALL")
def ill_formed(spark, sf):
    return ranking.ill_formed(_votes(spark, sf), CONV, 3)


@query(_CUT + "SELECT query, cand, (dense_rank() OVER (PARTITION BY query ORDER BY levenshtein(query, cand)) - 1)::INTEGER AS rank FROM cut")
def rank_by(spark, sf):
    return ranking.rank_by(_pairs(spark, sf), ["query"], F.levenshtein("query", "cand"), "rank")


@query()
def choose_candidate(spark, sf):
    return ranking.choose_candidate(_pairs(spark, sf), ["query"])


@query(BASE + "SELECT word, freq FROM (SELECT *, row_number() OVER (ORDER BY freq DESC, word) AS r, count(*) OVER () AS n FROM counts) WHERE r <= n * 10 // 100")
def take_percent(spark, sf):
    return ranking.take_percent(_counts(spark, sf), 10, [F.col("freq").desc(), F.col("word")])


@query(BASE + "SELECT word, row_number() OVER (ORDER BY word) + 4 AS id FROM counts")
def unique_ids(spark, sf):
    return lexicon.unique_ids(_counts(spark, sf), "word", 5)


@query(BASE + "SELECT conv_id, turn, len(tokens) >= 20 AS long, len(list_filter(tokens, lambda x: length(x) > 6)) >= 3 AS wordy FROM conv")
def at_least(spark, sf):
    return conversations(spark, sf).select(*CONV, S.at_least(F.col("tokens"), 20, lambda x: F.lit(True)).alias("long"), S.at_least(F.col("tokens"), 3, lambda x: F.length(x) > 6).alias("wordy"))


@query(BASE + "SELECT conv_id, turn, array_to_string(list_transform(tokens, lambda x: upper(x)), ' ') AS up, sum(length(t))::BIGINT AS n FROM (SELECT *, unnest(tokens) AS t FROM conv) GROUP BY conv_id, turn, tokens")
def map_values(spark, sf):
    c = conversations(spark, sf).filter(F.size("tokens") > 0)
    return c.select(*CONV, F.array_join(F.transform("tokens", lambda x: F.upper(x)), " ").alias("up"), F.aggregate("tokens", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("n"))


@query(BASE + "SELECT conv_id, array_to_string(flatten(list(tokens ORDER BY turn)), ' ') AS tokens FROM conv GROUP BY conv_id")
def flatten(spark, sf):
    c = conversations(spark, sf).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "tokens"))).alias("c"))
    return c.select("conv_id", F.array_join(F.flatten(F.transform("c", lambda x: x["tokens"])), " ").alias("tokens"))


@query(BASE + "SELECT conv_id, turn, (pos + 1)::INTEGER AS i, tok, length(tok)::BIGINT AS n FROM flat")
def map_row(spark, sf):
    c = conversations(spark, sf).select(*CONV, F.explode(S.indexed(F.col("tokens"), 1)).alias("p"))
    return c.select(*CONV, F.col("p.i").alias("i"), F.col("p.x").alias("tok"), F.length("p.x").cast("long").alias("n"))


@query("SELECT conv_id, turn, text FROM conversations WHERE text <> '' ORDER BY conv_id, turn, text LIMIT 25")
def take_first_n(spark, sf):
    return table(spark, sf, "conversations").filter("text <> ''").orderBy(*CONV, "text").limit(25).select(*CONV, "text")


def _models(spark, sf) -> normalise.Models:
    d = dictionary(spark, sf, COMMON)
    lm = langmodel.Model(*(saved(t, "lm") for t in vars(langmodel.train(documents(spark, sf))).values()))
    c = Config(lksm_num_candidates=3, nmd_min_freq=RARE)
    phonetic = saved(candidates.phonetic_dictionary(d), "phonetic")
    p = context.positive_features(conversations(spark, sf), CONV, d)
    bank = _bank(p)
    known = p.join(d.select(F.col("word").alias("dep")), "dep", "left_semi")
    pairs = candidates.confusion_set(d, d, phonetic, c.lex_dist, c.phon_dist).filter("query <> cand").select("query", "cand").distinct()
    f = saved(context.with_dependency_score(context.training_features(known, context.negative_features(known, pairs)), bank), "features")
    bank = saved(bank, "bank")
    mapping = saved(jobs.normalisation_pairs(documents(spark, sf), ["doc_id"], d, phonetic, c), "mapping")
    return normalise.Models(d, phonetic, lm, bank, classifier.train(f, c.lksm_solver), percent=50, mapping=mapping)


@query()
def normalisation_dictionary(spark, sf):
    d = dictionary(spark, sf, COMMON)
    return jobs.normalisation_pairs(documents(spark, sf), ["doc_id"], d, candidates.phonetic_dictionary(d), Config(nmd_min_freq=RARE))


@query()
def complex_normalise(spark, sf):
    out = normalise.complex_normalise(conversations(spark, sf), CONV, _models(spark, sf))
    return out.select(*CONV, F.array_join("tokens", " ").alias("tokens"), F.array_join("norm_tokens", " ").alias("norm_tokens"))


@query()
def duplex_normalise(spark, sf):
    out = normalise.duplex_normalise(conversations(spark, sf), CONV, _models(spark, sf))
    return out.select(*CONV, F.array_join("tokens", " ").alias("tokens"), F.array_join("norm_tokens", " ").alias("norm_tokens"))
