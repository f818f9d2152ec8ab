"""The engine's queries over the driver's tables, and the same in SQL.

All of them read their whole tables. Where nothing else is said, `documents.text` is indexed with the
plain English analyzer (no stems, no stop words), whatever the language of a document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions import analyzer
from quernstone.functions.known_stems import KNOWN_STEMS, SENTENCES
from quernstone.functions.scoring import DEFAULT_RELEVANCE, Relevance, bounded_levenshtein, common_prefix
from quernstone.functions.stopwords import stop_words
from quernstone.operators import index as ix
from quernstone.operators import match
from quernstone.plans.engine import SearchEngine
from quernstone.sources.readers import read_json, read_xml, spread
from quernstone.storage import new_folder, stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

PLAIN = ix.Analysis(stemming=False, stop_words=False)
#: Scores are compared after rounding, so that equal documents are equal however sums were made.
DIGITS = 6


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


# analyzer


def _split_sql(text: str, language: str) -> str:
    return f"list_filter(regexp_split_to_array(lower(coalesce({text}, '')), '{analyzer.separators(language).replace(chr(39), chr(39) * 2)}'), lambda t: t <> '')"


def _fold_sql(token: str, language: str) -> str:
    return "translate({}, '{}', '{}')".format(token, *analyzer.FOLDS[language])


def with_sentences(spark: SparkSession, sf_dir: str, language: str) -> DataFrame:
    """All documents and, with negative ids, some sentences of that language: the tables have but four languages."""
    more = spark.createDataFrame([(-n, t) for n, t in enumerate(SENTENCES[language], 1)], "doc_id long, text string")
    return documents(spark, sf_dir).select("doc_id", "text").union(more)


def _quoted(text: str) -> str:
    return "'{}'".format(text.replace("'", "''"))


def _counts(language: str, **options: bool) -> Query:
    """Tokens of every document as of that language. Columns are made when the query is: there is a session then."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tokens = analyzer.analyze(F.col("text"), language, **options) if options else analyzer.split(F.col("text"), language)
        rows = with_sentences(spark, sf_dir, language)
        return ix.counted(rows.select("doc_id", tokens.alias("tokens")), ["doc_id"], ix.repeated_ids(rows.select("doc_id")))

    return run


def _stems(language: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        words = spark.createDataFrame([(w,) for w, _ in KNOWN_STEMS[language]], "word string")
        return words.select("word", analyzer.analyze_unfolded(F.col("word"), language)[0].alias("stem"))

    return run


for _language in analyzer.LANGUAGES:
    _more = ", ".join(f"({-n}, {_quoted(t)})" for n, t in enumerate(SENTENCES[_language], 1))
    _tokens = f"(SELECT doc_id, unnest({_split_sql('text', _language)}) AS t FROM (SELECT doc_id, text FROM documents UNION ALL VALUES {_more}))"
    query(f"tokens_raw_{_language}", f"SELECT doc_id, t AS term, count(*) AS n FROM {_tokens} GROUP BY ALL")(_counts(_language))
    query(f"tokens_folded_{_language}", f"SELECT doc_id, {_fold_sql('t', _language)} AS term, count(*) AS n FROM {_tokens} GROUP BY ALL")(_counts(_language, stemming=False, stops=False))
    _words = ", ".join(_quoted(w) for w in sorted(stop_words(_language)))
    query(f"tokens_stop_{_language}", f"SELECT doc_id, {_fold_sql('t', _language)} AS term, count(*) AS n FROM {_tokens} WHERE t NOT IN ({_words}) GROUP BY ALL")(_counts(_language, stemming=False, stops=True))
    query(f"tokens_stemmed_{_language}")(_counts(_language, stemming=True, stops=True))
    # the stems were typed in, independently of the algorithm
    query(f"stems_{_language}", "SELECT word, stem FROM (VALUES " + ", ".join(f"({_quoted(w)}, {_quoted(x)})" for w, x in KNOWN_STEMS[_language]) + ") AS v(word, stem)")(_stems(_language))


@query("tokens_distinct", f"SELECT doc_id, len(list_distinct(list_transform({_split_sql('text', 'en')}, lambda t: {_fold_sql('t', 'en')}))) AS n FROM documents")
def tokens_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.size(analyzer.analyze(F.col("text"), "en", stemming=False, stops=False, duplicates=False)).alias("n"))


@query("supported_languages", "SELECT DISTINCT lang, coalesce(lang IN ('en', 'es', 'fr', 'hu', 'no', 'ru', 'sv'), false) AS supported FROM (SELECT lang FROM documents UNION ALL VALUES ('sv'), ('pl'), ('EN'), (''))")
def supported_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = documents(spark, sf_dir).select("lang").union(spark.createDataFrame([("sv",), ("pl",), ("EN",), ("",)], "lang string")).distinct()
    known = spark.createDataFrame([(x, analyzer.is_supported(x)) for x in analyzer.LANGUAGES], "lang string, yes boolean")
    return given.join(F.broadcast(known), "lang", "left").select("lang", F.coalesce("yes", F.lit(False)).alias("supported"))


@query("stemmed_vocabulary")
def stemmed_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each different word of each supported language, with its stem."""
    out = None
    for language in analyzer.LANGUAGES:
        own = documents(spark, sf_dir).filter(F.col("lang") == language).select(F.explode(analyzer.split(F.col("text"), language)).alias("word")).distinct()
        own = own.select(F.lit(language).alias("lang"), "word", F.element_at(analyzer.analyze(F.col("word"), language, stops=False), 1).alias("stem"))
        out = own if out is None else out.union(own)
    return out


# index


def index(spark: SparkSession, sf_dir: str, properties: list[str] | None = None, docs: DataFrame | None = None, analysis: ix.Analysis = PLAIN) -> ix.Index:
    """Not kept: what a query needs of it is computed within its own plan, with its filters pushed into it."""
    docs = (documents(spark, sf_dir) if docs is None else docs).withColumn("analyzed_as", F.lit("en"))
    fields = ix.flatten(docs, properties or ["text"], "doc_id", "analyzed_as")
    return ix.Index.build(fields, ["en"], analysis, keep=False, repeated=ix.repeated_ids(docs.select("doc_id")))


def _index_sql(properties: tuple[str, ...] = ("text",), table: str = "documents") -> str:
    fields = " UNION ALL ".join(f"SELECT doc_id AS id, '{p}' AS prop, {p} AS text FROM {table}" for p in properties)
    return f"""
        fields AS ({fields}),
        split AS (SELECT id, prop, {_split_sql('text', 'en')} AS ts FROM fields),
        lens AS (SELECT id, prop, len(ts) AS len FROM split),
        post AS (
            SELECT prop, term, id, count(*) / len::DOUBLE AS tf, len
            FROM (SELECT id, prop, len(ts) AS len, {_fold_sql('unnest(ts)', 'en')} AS term FROM split)
            GROUP BY prop, term, id, len
        ),
        terms AS (SELECT prop, term, count(*) AS df FROM post GROUP BY prop, term),
        stats AS (SELECT prop, avg(len) AS avg_len, count(*) AS n_docs FROM lens GROUP BY prop)"""


@query("flatten_fields", "SELECT doc_id AS id, p AS prop, lang, CASE p WHEN 'text' THEN coalesce(text, '') ELSE coalesce(source, '') END AS text FROM documents, (VALUES ('text'), ('source')) AS v(p)")
def flatten_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.flatten(documents(spark, sf_dir), ["source", "text"], "doc_id", "lang")


@query("field_lengths", f"WITH {_index_sql(('text', 'source'))} SELECT id, prop, len FROM lens")
def field_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir, ["text", "source"]).lengths


@query("postings_tf", f"WITH {_index_sql()} SELECT prop, term, id, round(tf, 9) AS tf, len FROM post")
def postings_tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).postings.withColumn("tf", F.round("tf", 9))


@query("doc_freq", f"WITH {_index_sql(('text', 'source'))} SELECT prop, term, df FROM terms")
def doc_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir, ["text", "source"]).term_stats


@query("field_stats", f"WITH {_index_sql(('text', 'source'))} SELECT prop, round(avg_len, {DIGITS}) AS avg_len, n_docs FROM stats")
def field_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir, ["text", "source"]).field_stats.withColumn("avg_len", F.round("avg_len", DIGITS))


@query("dictionary_size", f"WITH {_index_sql(('text', 'source'))} SELECT prop, count(*) AS terms FROM terms GROUP BY prop")
def dictionary_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.dictionary_sizes(index(spark, sf_dir, ["text", "source"]).term_stats)


@query("token_counts_conversations", f"SELECT conv_id, turn, t AS term, count(*) AS n FROM (SELECT conv_id, turn, unnest({_split_sql('text', 'en')}) AS t FROM conversations) GROUP BY ALL")
def token_counts_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return rows.select("conv_id", "turn", F.explode(analyzer.split(F.col("text"), "en")).alias("term")).groupBy("conv_id", "turn", "term").agg(F.count("*").alias("n"))


# matching

TOKENS = ("ther", "thing", "tion")
_Q = ", ".join(f"('{t}')" for t in TOKENS)
_MATCH_SQL = {
    match.EXACT: "term = token",
    match.PREFIX: "starts_with(term, token)",
    # terms are folded, so bytes are characters
    match.DOCUMENTED: "levenshtein(term, token) <= {tolerance}",
}
_TREE_SQL = """
        q AS (SELECT token, range(0, len(token) + 1) AS ns FROM (VALUES {tokens}) AS v(token)),
        steps AS (SELECT token, n, token[:n] AS head FROM q, unnest(ns) AS u(n)),
        seen AS (
            SELECT prop, token, n, bool_or(starts_with(term, head)) AS has,
                n = 0 OR bool_or(term = head) OR count(DISTINCT CASE WHEN starts_with(term, head) AND len(term) > n THEN term[n + 1:n + 1] END) > 1 AS node
            FROM steps, terms GROUP BY prop, token, n, head
        ),
        far AS (SELECT prop, token, max(n) FILTER (WHERE has OR n = 0) AS reach FROM seen GROUP BY prop, token),
        below AS (
            SELECT prop, token, CASE WHEN reach = len(token) THEN token WHEN bool_or(node AND n = reach) THEN NULL ELSE token[:max(n) FILTER (WHERE node AND n < reach)] END AS head
            FROM far JOIN seen USING (prop, token) GROUP BY prop, token, reach
        )"""


def _matched(mode: str, tolerance: int = 0) -> Query:
    return lambda spark, sf_dir: match.matches(index(spark, sf_dir).term_stats, list(TOKENS), mode, tolerance).select("token", "term", "df")


for _name, _mode, _tolerance in (("match_exact", match.EXACT, 0), ("match_prefix", match.PREFIX, 0), ("match_fuzzy", match.DOCUMENTED, 2)):
    query(_name, f"WITH {_index_sql()} SELECT token, term, df FROM terms JOIN (VALUES {_Q}) AS q(token) ON {_MATCH_SQL[_mode].format(tolerance=_tolerance)}")(_matched(_mode, _tolerance))

_TREE_TOKENS = ("therq", "thing", "tionx", "qqq", "anotherxyz")
_TREE_Q = ", ".join(f"('{t}')" for t in _TREE_TOKENS)


@query("match_fuzzy_tree", f"WITH {_index_sql()}, {_TREE_SQL.format(tokens=_TREE_Q)} SELECT b.token, t.term, t.df FROM below b JOIN terms t ON t.prop = b.prop AND starts_with(t.term, b.head) AND levenshtein(t.term, b.token) <= 2")
def match_fuzzy_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = stored(index(spark, sf_dir).term_stats)  # read twice, and edit distances are of terms and not of postings
    return match.matches(stats, list(_TREE_TOKENS), match.TREE, 2).select("token", "term", "df")


@query("edit_distances", "SELECT p_partkey, k AS place, CASE WHEN levenshtein(w[k], w[k + 1]) <= 4 THEN levenshtein(w[k], w[k + 1]) ELSE -1 END AS distance FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part), unnest(range(1, len(w))) AS u(k)")
def edit_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each two words of a name that follow one another."""
    words = F.split("p_name", " ")
    pairs = F.arrays_zip(words.alias("a"), F.slice(words, 2, F.size(words)).alias("b"))
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.posexplode(pairs).alias("place", "x")).filter("x.b is not null")
    return rows.select("p_partkey", (F.col("place") + 1).cast("long").alias("place"), bounded_levenshtein(F.col("x.a"), F.col("x.b"), 4).cast("long").alias("distance"))


@query("common_prefixes", "SELECT c_custkey, CASE WHEN n = 0 THEN '' ELSE c_name[:n] END AS prefix FROM (SELECT c_custkey, c_name, coalesce(list_max(list_filter(range(0, least(len(c_name), len(c_mktsegment)) + 1), lambda k: c_name[:k] = c_mktsegment[:k])), 0) AS n FROM customer)")
def common_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", common_prefix(F.col("c_name"), F.col("c_mktsegment")).alias("prefix"))


# search


def _search_sql(tokens: tuple[str, ...], properties: tuple[str, ...] = ("text",), mode: str = match.PREFIX, tolerance: int = 0, relevance: Relevance = DEFAULT_RELEVANCE, table: str = "documents", ctes: str = "") -> str:
    q = ", ".join(f"('{t}')" for t in tokens)
    if mode == match.TREE:
        tree, source = f", {_TREE_SQL.format(tokens=q)}", f"post t JOIN below b ON t.prop = b.prop AND starts_with(t.term, b.head) AND levenshtein(t.term, b.token) <= {tolerance}"
    else:
        tree, source = "", f"post t JOIN (VALUES {q}) AS v(token) ON {_MATCH_SQL[mode].format(tolerance=tolerance)}"
    k, b, d = (f"{x}::DOUBLE" for x in (relevance.k, relevance.b, relevance.d))
    return f"""WITH {ctes} {_index_sql(properties, table)}{tree},
        hits AS (SELECT t.id, t.prop, token, arg_max(tf, t.term) AS tf, arg_max(len, t.term) AS len FROM {source} GROUP BY t.id, t.prop, token),
        scored AS (
            SELECT id, round(sum(ln(1::DOUBLE + (n_docs - coalesce(df, 0) + 0.5::DOUBLE) / (coalesce(df, 0) + 0.5::DOUBLE)) * ({d} + tf * ({k} + 1::DOUBLE)) / (tf + {k} * (1::DOUBLE - {b} + {b} * len / avg_len))), {DIGITS}) AS score
            FROM hits JOIN stats USING (prop) LEFT JOIN terms ON terms.prop = hits.prop AND terms.term = hits.token GROUP BY id
        ) SELECT """


def engine(spark: SparkSession, docs: DataFrame, properties: tuple[str, ...] = ("text",), id_col: str = "doc_id", **options) -> SearchEngine:
    """An engine over a table; plain, and without a kept index where nothing else is said."""
    return SearchEngine(spark, docs, id_col=id_col, properties=list(properties), **{"stemming": False, "stop_words": False, "keep_index": False, **options})


def _engine_scores(e: SearchEngine, tokens: tuple[str, ...], properties: tuple[str, ...] = ("text",), mode: str = match.PREFIX, tolerance: int = 0, relevance: Relevance = DEFAULT_RELEVANCE) -> DataFrame:
    return e.scores(" ".join(tokens), list(properties), mode == match.EXACT, tolerance, relevance.k, relevance.b, relevance.d).select("id", F.round("score", DIGITS).alias("score"))


def _search(tokens: tuple[str, ...], properties: tuple[str, ...] = ("text",), mode: str = match.PREFIX, tolerance: int = 0, relevance: Relevance = DEFAULT_RELEVANCE) -> Query:
    return lambda spark, sf_dir: _engine_scores(engine(spark, documents(spark, sf_dir), properties, tolerance_mode=mode if mode == match.TREE else match.DOCUMENTED), tokens, properties, mode, tolerance, relevance)


for _name, _options in {
    "search_exact": ((("the", "ther"),), {"mode": match.EXACT}),
    "search_prefix": ((("the", "ther"),), {}),
    "search_fuzzy": ((("thing", "onion"),), {"mode": match.DOCUMENTED, "tolerance": 2}),
    "search_fuzzy_tree": ((_TREE_TOKENS,), {"mode": match.TREE, "tolerance": 2}),
    "search_multi_prop": ((("src1", "thing"), ("text", "source")), {}),
    "search_custom_bm25": ((("thing", "anat"),), {"relevance": Relevance(k=2.0, b=0.3, d=1.0)}),
    "search_idf_only": ((("thing", "anat"),), {"mode": match.EXACT, "relevance": Relevance()}),
}.items():
    query(_name, _search_sql(*_options[0], **_options[1]) + "id, score FROM scored")(_search(*_options[0], **_options[1]))


@query("search_page", _search_sql(("thing", "anat")) + "id, score FROM scored ORDER BY score DESC, id LIMIT 10 OFFSET 20")
def search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, documents(spark, sf_dir)).search("thing anat", offset=20, limit=10, digits=DIGITS).hits.select("id", "score")


@query("search_top", _search_sql(("thing", "anat"), mode=match.EXACT) + "id, score, lang, source, n_chars FROM (SELECT * FROM scored ORDER BY score DESC, id LIMIT 10) JOIN documents ON doc_id = id")
def search_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: whole words, BM25, the first ten with their documents."""
    return engine(spark, documents(spark, sf_dir)).search("thing anat", exact=True, digits=DIGITS).hits.select("id", "score", "data.lang", "data.source", "data.n_chars")


@query("search_count", _search_sql(("thing", "anat")) + "count(*) AS hits FROM scored")
def search_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(engine(spark, documents(spark, sf_dir)).search("thing anat", limit=0).count,)], "hits long")


@query("search_json", _search_sql(("thing", "anat"), mode=match.EXACT) + "'{\"id\":' || id || ',\"source\":\"' || source || '\"}' AS hit FROM (SELECT * FROM scored ORDER BY score DESC, id LIMIT 10) JOIN documents ON doc_id = id")
def search_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_top(spark, sf_dir).select(F.to_json(F.struct("id", "source")).alias("hit"))


@query(
    "search_envelope",
    _search_sql(("thing", "anat"))
    + "n.hits AS count, x.place, x.id, x.score, x.source FROM (SELECT count(*) AS hits FROM scored) n, (SELECT row_number() OVER (ORDER BY score DESC, id) AS place, s.id, s.score, d.source FROM scored s JOIN documents d ON d.doc_id = s.id ORDER BY score DESC, id LIMIT 10) x",
)
def search_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A response as a whole (all but its time), a row for each place of its hits."""
    found = engine(spark, documents(spark, sf_dir)).search("thing anat", digits=DIGITS).envelope()
    return found.select("count", F.posexplode("hits").alias("place", "h")).select("count", (F.col("place") + 1).cast("long").alias("place"), "h.id", "h.score", "h.data.source")


def _known_documents() -> list[tuple[int, str]]:
    """Documents of five words each out of the known English ones; words next to one another are two places apart in the list."""
    words = [w for w, x in KNOWN_STEMS["en"] if x and w not in stop_words("en") and len(w) > 3]
    return [(n, " ".join(words[(n + 7 * k) % len(words)] for k in range(5))) for n in range(len(words))]


_STEMMED = (
    "WITH known AS (SELECT * FROM (VALUES "
    + ", ".join(f"({_quoted(w)}, {_quoted(x)})" for w, x in KNOWN_STEMS["en"])
    + ") AS v(word, stem)), typed AS (SELECT * FROM (VALUES "
    + ", ".join(f"({n}, {_quoted(t)})" for n, t in _known_documents())
    + ") AS v(id, text)), words AS (SELECT id, stem AS term FROM (SELECT id, unnest(string_split(text, ' ')) AS word FROM typed) JOIN known USING (word)), "
    "post AS (SELECT id, term, count(*) / 5::DOUBLE AS tf FROM words GROUP BY id, term), terms AS (SELECT term, count(*) AS df FROM post GROUP BY term), "
    "n AS (SELECT count(*) AS n_docs FROM typed), "
    "hits AS (SELECT p.id, q.token, arg_max(tf, p.term) AS tf FROM post p JOIN (VALUES ('consol'), ('knight')) AS q(token) ON starts_with(p.term, q.token) GROUP BY p.id, q.token) "
    "SELECT h.id, round(sum(ln(1::DOUBLE + (n_docs - coalesce(df, 0) + 0.5::DOUBLE) / (coalesce(df, 0) + 0.5::DOUBLE)) * (0.5::DOUBLE + tf * 2.2::DOUBLE) / (tf + 1.2::DOUBLE)), 6) AS score "
    "FROM n, hits h LEFT JOIN terms ON terms.term = h.token GROUP BY h.id"
)


@query("search_stemmed", _STEMMED)
def search_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As a request without options, with stems and stop words, over documents of words whose stems are known; each has five tokens."""
    docs = spark.createDataFrame(_known_documents(), "id long, text string")
    e = engine(spark, docs, id_col="id", stemming=True, stop_words=True, keep_index=True)
    return e.scores("the consolation of knights", ["text"]).select("id", F.round("score", DIGITS).alias("score"))


@query("search_stemmed_documents")
def search_stemmed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over all documents."""
    return engine(spark, documents(spark, sf_dir), stemming=True, stop_words=True).scores("the thinging of nations", ["text"]).select("id", F.round("score", DIGITS).alias("score"))


@query("search_conversations", _search_sql(("thing", "tion"), table="conv", ctes="conv AS (SELECT conv_id * 1000 + turn AS doc_id, text FROM conversations),") + "id, score FROM scored")
def search_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    return _engine_scores(engine(spark, rows), ("thing", "tion"))


# the engine's schema, ids and changes


@query("property_discovery", "SELECT column_name AS path FROM (DESCRIBE SELECT * FROM documents) WHERE column_type = 'VARCHAR' UNION ALL VALUES ('author.name'), ('author.contact.email')")
def property_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """String columns of the documents, with nested ones put beside them; numbers aren't searchable."""
    author = F.struct(F.lit("x").alias("name"), F.struct(F.lit("y").alias("email"), F.lit(1).alias("age")).alias("contact"))
    return spark.createDataFrame([(p,) for p in ix.string_paths(documents(spark, sf_dir).withColumn("author", author).schema)], "path string")


def _more(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select((F.col("item_id") + 1_000_000_000_000).alias("doc_id"), "text")


@query("id_membership", "SELECT DISTINCT id AS doc_id, id IN (SELECT doc_id FROM documents WHERE doc_id IS NOT NULL) AS known FROM (SELECT doc_id AS id FROM labels UNION ALL SELECT item_id + 1000000000000 FROM benchmark)")
def id_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id").union(_more(spark, sf_dir).select("doc_id"))
    return engine(spark, documents(spark, sf_dir)).known(ids)


def _plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", "text", "source")


def _updated(spark: SparkSession, sf_dir: str) -> SearchEngine:
    e = engine(spark, _plain(spark, sf_dir))
    e.update(_plain(spark, sf_dir).filter("source = 'src1'").withColumn("text", F.concat(F.lit("updated thing "), "source")))
    return e


def _deleted(spark: SparkSession, sf_dir: str, **options: bool) -> SearchEngine:
    e = engine(spark, _plain(spark, sf_dir), **options)
    e.delete(_plain(spark, sf_dir).filter("source = 'src2'"))
    return e


def _inserted(spark: SparkSession, sf_dir: str, **options: bool) -> SearchEngine:
    e = engine(spark, _plain(spark, sf_dir).select("doc_id", "text"), **options)
    e.insert(_more(spark, sf_dir))
    return e


def _batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of three kinds: all benchmark items, the same once more, and all documents of one source, which are there already."""
    more = _more(spark, sf_dir)
    return more.union(more).union(_plain(spark, sf_dir).filter("source = 'src2'").select("doc_id", F.lit("of no account").alias("text")))


def _batched(spark: SparkSession, sf_dir: str) -> SearchEngine:
    e = engine(spark, _plain(spark, sf_dir).select("doc_id", "text"))
    e.insert_batch(_batch(spark, sf_dir), 1000)
    return e


_UPDATED = "SELECT doc_id, CASE WHEN source = 'src1' THEN 'updated thing ' || source ELSE text END AS text FROM documents"
_DELETED = "SELECT doc_id, text FROM documents WHERE source IS DISTINCT FROM 'src2'"
_INSERTED = "SELECT doc_id, text FROM documents UNION ALL SELECT item_id + 1000000000000, text FROM benchmark"
_TOKENS = ("thing", "anat", "updated")

for _name, _engine, _sql in (("after_update", _updated, _UPDATED), ("after_delete", _deleted, _DELETED), ("after_insert", _inserted, _INSERTED), ("after_batch", _batched, _INSERTED)):
    query(_name, _search_sql(_TOKENS, table="changed", ctes=f"changed AS ({_sql}),") + "id, score FROM scored")(lambda spark, sf_dir, _engine=_engine: _engine_scores(_engine(spark, sf_dir), _TOKENS))


@query("batch_errors", "SELECT item_id + 1000000000000 AS doc_id, 'DocumentAlreadyExists' AS error FROM benchmark UNION ALL SELECT doc_id, 'DocumentAlreadyExists' FROM documents WHERE source = 'src2'")
def batch_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, _plain(spark, sf_dir).select("doc_id", "text")).insert_batch(_batch(spark, sf_dir), 1000)


@query("index_after_delete", f"WITH changed AS ({_DELETED}), {_index_sql(table='changed')} SELECT prop, term, df FROM terms")
def index_after_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kept index of an engine from which documents were deleted."""
    return _deleted(spark, sf_dir, keep_index=True).index.term_stats.select("prop", "term", "df")


@query("index_saved_and_read", f"WITH changed AS ({_INSERTED}), {_index_sql(table='changed')} SELECT prop, term, id, round(tf, 9) AS tf, len FROM post")
def index_saved_and_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved, read, added to, saved in the same folder and read again."""
    folder = new_folder(spark, "engine")
    engine(spark, _plain(spark, sf_dir).select("doc_id", "text"), keep_index=True).save(folder)
    e = engine(spark, None, keep_index=True).load(folder)
    e.insert(_more(spark, sf_dir))
    e.save(folder)
    SearchEngine.vacuum(spark, folder)
    return engine(spark, None).load(folder).index.postings.select("prop", "term", "id", F.round("tf", 9).alias("tf"), "len")


# sources


@query("xml_round_trip", "SELECT coalesce(source, '') AS title, coalesce(lang, '') || '/' || doc_id AS url, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS abstract FROM documents")
def xml_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as gzipped XML dumps, read as such."""
    folder = new_folder(spark, "xml")
    docs = documents(spark, sf_dir).select(
        F.coalesce("source", F.lit("")).alias("title"), F.concat_ws("/", F.coalesce("lang", F.lit("")), F.col("doc_id").cast("string")).alias("url"), F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")).alias("abstract")
    )
    docs.write.format("xml").option("rootTag", "feed").option("rowTag", "doc").option("compression", "gzip").save(folder)
    return read_xml(spark, folder)


@query("json_lines", "SELECT coalesce(source, '') AS title, CAST(doc_id AS VARCHAR) AS url, coalesce(text, '') AS abstract FROM documents")
def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as JSON lines, read as such."""
    folder = new_folder(spark, "json")
    documents(spark, sf_dir).select(F.coalesce("source", F.lit("")).alias("title"), F.col("doc_id").cast("string").alias("url"), F.coalesce("text", F.lit("")).alias("abstract")).write.json(folder)
    return read_json(spark, folder, required=())
