from __future__ import annotations

import gzip
import math
import random

import pytest
from pyspark.sql import functions as F

from quernstone.errors import DocumentAlreadyExists, DocumentNotFound, DocumentsDiffer, LanguageNotSupported, PropertyNotSearchable
from quernstone.functions import analyzer, scoring
from quernstone.functions.known_stems import KNOWN_STEMS
from quernstone.functions.stemmers import stem
from quernstone.functions.stopwords import stop_words
from quernstone.operators import index as ix
from quernstone.operators import match
from quernstone.plans.engine import SearchEngine
from quernstone.sources.readers import read_json, read_xml
from quernstone.sources.service import DocumentService, Failure

USERS = [
    ("Tom Haris", "tom@email.com"), ("Jane", "myne123@email.com"), ("Bob Brown", "bob03@email.com"), ("Charlie Davis", "char@email.com"), ("Tom Brown", "brown@email.com"),
    ("Charlie Anderson", "anderson@email.com"), ("Julia Hernandez", "juliah@email.com"), ("Lucy Johnson", "lucy@email.com"), ("Frank", "fischer@email.com"), ("Eve Anderson", "eve@email.com"),
]
PLAIN = {"k": 0.0, "b": 0.0, "d": 0.0}


def frame(spark, rows):
    return spark.createDataFrame([(str(n), a, b) for n, (a, b) in rows], "id string, name string, email string")


@pytest.fixture(scope="module")
def engine(spark):
    return SearchEngine(spark, frame(spark, enumerate(USERS)), stemming=False, stop_words=False)


def hits(result):
    return [(r["id"], r["score"]) for r in result.hits.collect()]


def test_search_one_property(engine):
    r = engine.search("charlie davis", ["name"], **PLAIN)
    assert r.count == 2
    assert hits(r) == [("3", pytest.approx(3.4740347056144216, abs=1e-12)), ("5", pytest.approx(1.4816045409242156, abs=1e-12))]


def test_search_prefix_has_the_frequency_of_the_token(engine):
    r = engine.search("julia tom", ["name", "email"], **PLAIN)
    assert r.count == 3
    assert hits(r) == [(i, pytest.approx(s, abs=1e-12)) for i, s in (("6", 5.083472618048522), ("0", 3.4740347056144216), ("4", 1.4816045409242156))]
    assert r.hits.first()["data"]["name"] == "Julia Hernandez"


def test_exact_is_within_prefix_and_tolerance_is_monotone(engine):
    def ids(**options):
        return {r["id"] for r in engine.scores("tom brow", **options).collect()}

    assert ids(exact=True) <= ids()
    assert ids(exact=True) <= ids(tolerance=1) <= ids(tolerance=2) <= ids(tolerance=3)
    assert ids(exact=True, tolerance=2) == ids(exact=True)


def test_pages_make_up_the_whole(engine):
    whole = hits(engine.search("brown anderson tom", limit=100))
    assert len(whole) == engine.search("brown anderson tom", limit=0).count
    assert [h for o in range(0, len(whole) + 2, 2) for h in hits(engine.search("brown anderson tom", offset=o, limit=2))] == whole
    with pytest.raises(ValueError):
        engine.search("brown", offset=-1)


def test_a_property_named_twice_counts_twice(engine):
    once, twice = (dict(engine.scores("tom", p).collect()) for p in (["name"], ["name", "name"]))
    assert twice == {k: pytest.approx(2 * v) for k, v in once.items()}


def test_errors(spark, engine):
    with pytest.raises(PropertyNotSearchable):
        engine.search("tom", ["nothing"])
    assert engine.search("!!", ["nothing"]).count == 0
    with pytest.raises(LanguageNotSupported):
        engine.search("tom", language="pl")
    with pytest.raises(LanguageNotSupported):
        SearchEngine(spark, default_language="pl")
    with pytest.raises(PropertyNotSearchable):
        SearchEngine(spark, spark.createDataFrame([(1, 2.0)], "id int, x double"), properties=["x"])
    with pytest.raises(ValueError):
        engine.search("")


def table(engine):
    return {(r["prop"], r["term"], r["id"], r["len"]) for r in engine.index.postings.collect()}, {(r["prop"], r["avg_len"], r["n_docs"]) for r in engine.index.field_stats.collect()}


def test_dictionary_sizes(spark, engine):
    assert dict(ix.dictionary_sizes(engine.index.term_stats).collect()) == {"name": 14, "email": 12}


def test_changes_are_rebuilds(spark):
    e = SearchEngine(spark, frame(spark, enumerate(USERS[:8])), stemming=False, stop_words=False)
    e.insert(frame(spark, [(8, USERS[8]), (9, USERS[9])]))
    assert table(e) == table(SearchEngine(spark, frame(spark, enumerate(USERS)), stemming=False, stop_words=False))
    with pytest.raises(DocumentAlreadyExists):
        e.insert({"id": "3", "name": "x", "email": "y"})
    changed = {**dict(enumerate(USERS)), 3: ("Charlie Davis Brown", "new@email.com")}
    e.update(frame(spark, [(3, changed[3])]))
    assert table(e) == table(SearchEngine(spark, frame(spark, changed.items()), stemming=False, stop_words=False))
    e.delete(["3", "5"])
    assert table(e) == table(SearchEngine(spark, frame(spark, [(k, v) for k, v in changed.items() if k not in (3, 5)]), stemming=False, stop_words=False))
    assert e.count == 8
    for call in (lambda: e.delete(["3"]), lambda: e.update(frame(spark, [(77, USERS[0])]))):
        with pytest.raises(DocumentNotFound):
            call()
    e.delete([str(n) for n in (0, 1, 2, 4, 6, 7, 8, 9)])
    assert e.count == 0 and e.search("tom").count == 0


def test_batch_reports_repeated_ids(spark):
    e = SearchEngine(spark, frame(spark, enumerate(USERS[:2])), stemming=False, stop_words=False)
    errors = e.insert_batch(frame(spark, [(1, USERS[1]), (2, USERS[2]), (2, USERS[3]), (3, USERS[4])]), 1000)
    assert sorted(tuple(r) for r in errors.collect()) == [("1", "DocumentAlreadyExists"), ("2", "DocumentAlreadyExists")] and e.count == 4
    assert e.insert_batch(frame(spark, [(1, USERS[1])] * 3 + [(5, USERS[5])])).count() == 3 and e.count == 5


def test_a_change_that_fails_changes_nothing(spark):
    for keep in (True, False):
        e = SearchEngine(spark, frame(spark, enumerate(USERS[:3])), stemming=False, stop_words=False, keep_index=keep)
        before = e._state
        whole = frame(spark, [(1, USERS[4])])
        for call, error in (
            (lambda: e.update(whole.drop("email")), DocumentsDiffer),
            (lambda: e.update(whole.withColumn("more", F.lit(1))), DocumentsDiffer),
            (lambda: e.update(whole.withColumn("name", F.lit(1))), DocumentsDiffer),
            (lambda: e.update(whole.union(whole)), DocumentAlreadyExists),
            (lambda: e.update(whole.union(frame(spark, [(9, USERS[9])]))), DocumentNotFound),
            (lambda: e.insert(whole.union(frame(spark, [(9, USERS[9])]))), DocumentAlreadyExists),
            (lambda: e.insert_batch(whole.drop("name")), DocumentsDiffer),
            (lambda: e.delete(["1", "9"]), DocumentNotFound),
            (lambda: e.update(whole, "pl"), LanguageNotSupported),
        ):
            with pytest.raises(error):
                call()
            assert e._state is before
        assert e.count == 3 and e.search("jane").count == 1
        e.update(whole)
        assert e.count == 3 and e.search("jane").count == 0 and e.search("tom").count == 2


def test_with_and_without_a_kept_index(spark):
    docs = frame(spark, [*enumerate(USERS), (10, (None, "")), (11, ("tom tom bob", None))])
    for tolerance_mode in (match.DOCUMENTED, match.TREE):
        kept, scan = (SearchEngine(spark, docs, stemming=False, stop_words=False, tolerance_mode=tolerance_mode, keep_index=k) for k in (True, False))
        for options in ({}, {"exact": True}, {"tolerance": 1}, {"tolerance": 2, "properties": ["email", "name", "name"]}, {"k": 0.0, "b": 0.0, "d": 0.0}):
            for query in ("tom brow", "andersom", "email", "nothing"):
                a, b = (sorted((r["id"], round(r["score"], 9)) for r in e.scores(query, **options).collect()) for e in (kept, scan))
                assert a == b, (query, options)
    assert scan.index is None and scan.search("!!").count == 0


def test_deletes_are_compacted_too(spark, monkeypatch):
    from quernstone.plans import engine as module

    monkeypatch.setattr(module, "COMPACT_AFTER", 3)
    e = SearchEngine(spark, frame(spark, enumerate(USERS)), stemming=False, stop_words=False)
    plans = []
    for n in range(9):
        e.delete([str(n)])
        plans.append(e.index.postings._jdf.queryExecution().optimizedPlan().toString().count("Join"))
    assert max(plans) <= 2 and min(plans) == 0 and e.count == 1 and e.search("eve").count == 1


def test_ids_are_made_and_nested_properties(spark):
    df = spark.sql("select 'A title' title, 'words here' abstract, 'u' url, named_struct('name', 'Ann', 'email', 'ann@x.org', 'age', 3) author")
    assert ix.string_paths(df.schema) == ["abstract", "author.email", "author.name", "title", "url"]
    e = SearchEngine(spark, df, properties=["title", "abstract", "author.name"])
    assert e.search("ann", ["author.name"]).count == 1 and e.search("ann", ["title"]).count == 0
    assert len(e.documents.first()["id"]) == 36


def test_languages_of_documents(spark):
    df = spark.createDataFrame([("1", "misslyckas svår", "sv"), ("2", "alive things", None), ("3", None, "ru")], "id string, text string, lang string")
    e = SearchEngine(spark, df, properties=["text"], lang_col="lang")
    assert {r["term"] for r in e.index.postings.collect()} == {"misslyck", "svar", "aliv", "thing"}
    assert e.index.field_stats.first()["n_docs"] == 3
    assert e.search("misslyckande", language="sv").count == 1
    with pytest.raises(LanguageNotSupported):
        SearchEngine(spark, df.withColumn("lang", F.lit("de")), properties=["text"], lang_col="lang")


def test_save_and_load(spark, engine, tmp_path):
    engine.save(f"{tmp_path}/e")
    again = SearchEngine(spark, stemming=False, stop_words=False).load(f"{tmp_path}/e")
    assert hits(again.search("julia tom")) == hits(engine.search("julia tom"))
    assert table(again) == table(engine)


def test_saving_again_where_it_was_read(spark, tmp_path):
    folder = f"{tmp_path}/e"
    e = SearchEngine(spark, frame(spark, enumerate(USERS[:5])), stemming=False, stop_words=False)
    assert e.save(folder) == 1
    reader = SearchEngine(spark, stemming=False, stop_words=False).load(folder)
    e = SearchEngine(spark, stemming=False, stop_words=False).load(folder)
    e.insert(frame(spark, [(5, USERS[5])]))
    assert e.save(folder) == 2 and e.count == 6 and reader.count == 5
    e.delete(["0"])
    assert e.save(folder) == 3
    # a version that wasn't completed counts for nothing
    (tmp_path / "e" / "v000000004" / "documents").mkdir(parents=True)
    again = SearchEngine(spark, stemming=False, stop_words=False).load(folder)
    assert again.count == 5 and table(again) == table(SearchEngine(spark, frame(spark, list(enumerate(USERS[:6]))[1:]), stemming=False, stop_words=False))
    SearchEngine.vacuum(spark, folder)
    assert sorted(p.name for p in (tmp_path / "e").iterdir()) == ["v000000003", "v000000004"] and again.search("jane").count == 1
    with pytest.raises(FileNotFoundError):
        SearchEngine(spark).load(f"{tmp_path}/none")


@pytest.mark.parametrize(
    ("tf", "df", "length", "average", "n", "k", "b", "d", "expected"),
    [(1.0, 1, 10, 10.0, 1, 1.0, 1.0, 1.0, 0.43152310867767135), (0.5, 1, 10, 12.43, 2, 1.2, 0.75, 0.5, 0.7276874539155506), (0.75, 1, 10, 5.32, 3, 1.2, 0.75, 0.5, 0.7691433563655649)],
)
def test_bm25(spark, tf, df, length, average, n, k, b, d, expected):
    got = spark.range(1).select(scoring.bm25(F.lit(tf), F.lit(df), F.lit(length), F.lit(average), F.lit(n), scoring.Relevance(k, b, d))).first()[0]
    assert math.isclose(got, expected, rel_tol=1e-14)


@pytest.mark.parametrize(("a", "b", "tolerance", "expected"), [("", "", 1, 0), ("kitten", "sitting", 1, -1), ("Saturday", "Sunday", 3, 3), ("foo", "bar", 2, -1)])
def test_levenshtein(spark, a, b, tolerance, expected):
    assert spark.range(1).select(scoring.bounded_levenshtein(F.lit(a), F.lit(b), tolerance)).first()[0] == expected


@pytest.mark.parametrize(("a", "b", "expected"), [("hello", "world", ""), ("hello", "hello", "hello"), ("hello", "hello world", "hello"), ("读写", "读写汉字", "读写")])
def test_common_prefix(spark, a, b, expected):
    assert spark.range(1).select(scoring.common_prefix(F.lit(a), F.lit(b))).first()[0] == expected


def test_counts_and_pages():
    assert scoring.count_tokens([]) == {} and scoring.count_tokens(["this", "is", "duplicated", "duplicated", "is"]) == {"this": 1, "is": 2, "duplicated": 2}
    assert [scoring.page_bounds(*x) for x in ((5, 5, 10), (0, 10, 11), (11, 10, 20), (0, 10, 5))] == [(5, 10), (0, 10), (11, 20), (0, 5)]


ANALYZED = [
    ("", "en", False, []), ("it's alive! it's alive!", "en", False, ["it", "aliv"]), ("it's alive! it's alive!", "en", True, ["it", "aliv", "it", "aliv"]),
    ("att sova är en svår sak när testerna misslyckas", "sv", False, ["sov", "ar", "svar", "sak", "test", "misslyck"]),
]


@pytest.mark.parametrize(("text", "language", "duplicates", "expected"), ANALYZED)
def test_analyzer(spark, text, language, duplicates, expected):
    assert analyzer.analyze_text(text, language, duplicates=duplicates) == expected
    assert spark.createDataFrame([(text,)], "t string").select(analyzer.analyze(F.col("t"), language, duplicates=duplicates)).first()[0] == expected


def test_unsupported_language():
    assert not analyzer.is_supported("pl")
    with pytest.raises(LanguageNotSupported):
        analyzer.analyze_text("test", "pl")


def test_analyzer_is_the_same_on_the_driver(spark):
    rng = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyzàéèüöåäñçœæøűабвгёй ' - _ 0 9 . ,"
    texts = ["".join(rng.choice(letters) for _ in range(200)) for _ in range(30)] + [None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for language in analyzer.LANGUAGES:
        for stemming in (False, True):
            got = [r[0] for r in df.select(analyzer.analyze(F.col("t"), language, stemming=stemming, stops=stemming)).collect()]
            assert got == [analyzer.analyze_text(t or "", language, stemming=stemming, stops=stemming) for t in texts], language


def test_published_samples_of_stems():
    for language, pairs in KNOWN_STEMS.items():
        assert [(w, stem(w, language)) for w, _ in pairs] == pairs, language


def test_stop_words_and_stems():
    assert [len(stop_words(x)) for x in ("en", "fr", "hu", "no", "ru", "es", "sv")] == [317, 436, 737, 119, 421, 284, 386]
    for language, pairs in {
        "en": "consistently consist relational relat happiness happi generously generous skies sky hopping hop hoping hope national nation",
        "fr": "continuellement continuel majestueusement majestu mangerait mang chevaux cheval université univers",
        "es": "cantando cant rápidamente rapid chicas chic torneos torne",
        "ru": "важная важн красивыми красив говорила говор",
        "sv": "jaktkarlarne jaktkarl klostergårdarna klostergård",
        "no": "havnedistriktene havnedistrikt opplysningene opplysning",
        "hu": "babáknak baba asztalok asztal",
    }.items():
        words = pairs.split()
        assert [stem(w, language) for w in words[::2]] == words[1::2]


TERMS = ["australian", "australia", "austrian"]


def terms_of(spark, token, mode, tolerance=0, terms=TERMS):
    df = spark.createDataFrame([("p", t) for t in terms], "prop string, term string")
    return sorted(r["term"] for r in match.matches(df, [token], mode, tolerance).collect())


def test_term_matches(spark):
    assert terms_of(spark, "what", match.PREFIX) == []
    assert terms_of(spark, "australia", match.EXACT) == ["australia"]
    assert terms_of(spark, "australia", match.PREFIX) == ["australia", "australian"]
    assert terms_of(spark, "australian", match.TREE, 2) == ["australian"]
    assert terms_of(spark, "austra", match.TREE, 3) == ["australia"]
    assert terms_of(spark, "austra", match.DOCUMENTED, 3) == ["australia", "austrian"]


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i, *row[1:]], row
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
    return row[-1]


def test_tree_mode_is_the_walk(spark):
    """Against a walk over a compressed prefix tree, put up from its set of nodes."""
    rng = random.Random(5)
    for _ in range(6):
        terms = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 6))) for _ in range(7)})
        tokens = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 7))) for _ in range(8)})
        nodes = {"", *terms} | {t[:n] for t in terms for n in range(len(t)) if len({u[n : n + 1] for u in terms if u[:n] == t[:n]}) > 1}
        df = spark.createDataFrame([("p", t) for t in terms], "prop string, term string")
        got = {(r["token"], r["term"]) for r in match.matches(df, tokens, match.TREE, 1).collect()}
        want = set()
        for q in tokens:
            at, below = "", None
            while below is None:
                if at == q:
                    below = at
                    break
                edges = [n for n in nodes if len(n) > len(at) and n.startswith(q[: len(at) + 1]) and not any(m != n and len(m) > len(at) and n.startswith(m) and m.startswith(at) for m in nodes)]
                if not edges:
                    break
                edge = edges[0]
                if q.startswith(edge):
                    at = edge
                elif edge.startswith(q):
                    below = edge
                else:
                    below = at
            if below is not None:
                want |= {(q, t) for t in terms if t.startswith(below) and lev(t, q) <= 1}
        assert got == want, (terms, got ^ want)


def test_sources(spark, tmp_path):
    path = tmp_path / "dump.xml.gz"
    with gzip.open(path, "wt") as f:
        f.write("<feed><doc><title>One</title><url>u1</url><abstract>first words</abstract></doc><doc><title>Two</title><url>u2</url></doc></feed>")
    assert sorted(tuple(r) for r in read_xml(spark, str(path)).collect()) == [("One", "u1", "first words"), ("Two", "u2", "")]
    (tmp_path / "d.json").write_text('{"title": "A", "url": "u", "abstract": "b"}\n')
    assert [tuple(r) for r in read_json(spark, f"{tmp_path}/d.json").collect()] == [("A", "u", "b")]
    (tmp_path / "e.json").write_text('{"title": "A", "url": "u"}\n')
    with pytest.raises(Exception, match="required"):
        read_json(spark, f"{tmp_path}/e.json").collect()
    service = DocumentService(spark)
    assert service.upload([str(path)]) == {"total": 2, "success": 2, "fail": 0}
    made = service.create({"title": "Three things", "url": "u3", "abstract": "first of all"}, lang="EN")
    found = service.search({"query": "thing", "limit": 5})
    assert found["count"] == 1 and found["hits"][0]["id"] == made["id"] and found["hits"][0]["data"]["url"] == "u3"
    service.update(made["id"], {"title": "Four", "url": "u4", "abstract": "nothing"})
    assert service.search({"query": "thing"})["count"] == 0
    service.delete(made["id"])
    for name, content in (("plain.xml.gz", b"<feed><doc><title>x</title></doc></feed>"), ("broken.xml.gz", gzip.compress(b"<feed><doc><title>x</doc></feed>")), ("plain.xml", b"<feed/>")):
        (tmp_path / name).write_bytes(content)
        n = service.engine.count
        with pytest.raises(Failure) as e:
            service.upload([str(tmp_path / name)])
        assert e.value.status == 400 and service.engine.count == n, name
    for status, call in ((404, lambda: service.delete(made["id"])), (400, lambda: service.create({"title": "x"})), (400, lambda: service.search({})), (400, lambda: service.create({"title": "x", "url": "y", "abstract": "z"}, lang="de"))):
        with pytest.raises(Failure) as e:
            call()
        assert e.value.status == status


def test_streaming_ingest(spark, tmp_path):
    from quernstone.streaming.ingest import ingest

    frame(spark, enumerate(USERS)).write.parquet(f"{tmp_path}/in")
    e = SearchEngine(spark, stemming=False, stop_words=False)
    for _ in range(2):  # what is there already isn't added again
        q = ingest(spark.readStream.schema("id string, name string, email string").parquet(f"{tmp_path}/in"), e, f"{tmp_path}/c{_}")
        q.awaitTermination(60)
    assert e.count == 10 and e.search("tom").count == 2


def _grouped(rows, keys):
    return {tuple(r) for r in rows.select(*keys, F.explode("tokens").alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("n")).collect()}


def test_tokens_are_counted_in_rows_without_a_shuffle(spark):
    rng = random.Random(11)
    arrays = [[], ["a"], ["a", "a"], ["b", "a", "b"], *([rng.choice("abcdefé") * rng.randint(1, 2) for _ in range(rng.randint(0, 40))] for _ in range(60))]
    rows = spark.createDataFrame(list(enumerate(arrays)), "id long, tokens array<string>")
    assert ix.repeated_ids(rows.select("id")) is None
    got = ix.counted(rows, ["id"], None)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in got.collect()} == _grouped(rows, ["id"]) and got.count() == len(_grouped(rows, ["id"]))
    ends = ix.counted_in_rows(rows, ["id"], ends=True).filter("term is null")
    assert sorted(r["id"] for r in ends.collect()) == list(range(len(arrays)))


@pytest.mark.parametrize("most", [0, 1 << 20])
def test_rows_of_repeated_ids_are_counted_together(spark, monkeypatch, most):
    monkeypatch.setattr(ix, "BROADCAST_BYTES", most)
    rows = spark.createDataFrame([(1, ["a", "b"]), (1, ["b", "c"]), (None, ["a"]), (None, ["a", "a"]), (2, ["a"]), (3, []), (3, [])], "id long, tokens array<string>")
    repeated = ix.repeated_ids(rows.select("id"))
    assert {r[0] for r in repeated.collect()} == {1, None, 3}
    got = [tuple(r) for r in ix.counted(rows, ["id"], repeated).collect()]
    assert len(got) == 5 and {*got} == _grouped(rows, ["id"]) == {(1, "a", 1), (1, "b", 2), (1, "c", 1), (None, "a", 3), (2, "a", 1)}


@pytest.mark.parametrize("language", analyzer.LANGUAGES)
def test_splitting_is_by_the_separators_whatever_stands_for_what(spark, language):
    high, below = analyzer.stand_ins(language)
    assert len(high) == len(below) and not {*below} & {*"\\^]-[&"}
    texts = [f"{high} {below} x{below}y", "".join(f"z{chr(n)}" for n in range(1, 0x600)), "Ő Űű ÉÑ ЁЖ-ё œŒ Š ǅ 読む x\U0001f600y", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.array_remove(F.split(F.lower(F.coalesce("t", F.lit(""))), analyzer.separators(language), -1), "")
    for r in df.select(analyzer.split(F.col("t"), language).alias("a"), plain.alias("b"), analyzer.analyze(F.col("t"), language, stemming=False, stops=False).alias("c"), F.transform(plain, lambda t: analyzer.fold(t, language)).alias("d")).collect():
        assert r["a"] == r["b"] and r["c"] == r["d"]


def test_batches_are_stemmed_piece_by_piece(spark, monkeypatch):
    import pyarrow as pa

    sizes = []
    real = analyzer.stems_of
    monkeypatch.setattr(analyzer, "stems_of", lambda words, language: sizes.append(len(words)) or real(words, language))
    monkeypatch.setattr(analyzer, "STEMMED_AT_ONCE", 7)
    arrays = [["knives", "knocked"] * n for n in range(6)] + [None, []]
    got = analyzer._stemmer("en").func(pa.array(arrays, pa.list_(pa.string())))
    assert got.to_pylist() == [[stem(w, "en") for w in a or ()] for a in arrays]
    assert max(sizes) == 7 and sum(sizes) == 30


def test_saving_after_an_insert_writes_what_came_since(spark, tmp_path, monkeypatch):
    from quernstone.plans import engine as module

    def words(n):
        return [p for p in (tmp_path / "e" / f"v{n:09}" / "documents").iterdir() if p.name.endswith(".parquet")]

    def of(n):
        return spark.read.parquet(*map(str, words(n))).count()

    folder = f"{tmp_path}/e"
    e = SearchEngine(spark, frame(spark, enumerate(USERS[:5])), stemming=False, stop_words=False)
    e.save(folder)
    e.insert(frame(spark, [(5, USERS[5])]))
    e.insert(frame(spark, [(6, (None, "tom"))]))
    assert e.save(folder) == 2 and of(2) == 2
    e = SearchEngine(spark, stemming=False, stop_words=False).load(folder)
    assert e.save(folder) == 3 and of(3) == 0
    SearchEngine.vacuum(spark, folder)
    again = SearchEngine(spark, stemming=False, stop_words=False).load(folder)
    whole = SearchEngine(spark, frame(spark, [*enumerate(USERS[:6]), (6, (None, "tom"))]), stemming=False, stop_words=False)
    assert table(again) == table(whole) and again.count == 7
    assert {tuple(r) for r in again.index.term_stats.collect()} == {tuple(r) for r in whole.index.term_stats.collect()}
    for options in ({}, {"exact": True}, {"tolerance": 1}):
        assert hits(again.search("tom davis", **options)) == hits(whole.search("tom davis", **options))
    # whole again: after a change that removes, in another folder, and beyond so many parts
    again.save(f"{tmp_path}/other")
    assert not [p for p in (tmp_path / "other" / "v000000001").iterdir() if p.name.startswith("_WITH")]
    monkeypatch.setattr(module, "MOST_PARTS", 3)
    assert e.save(folder) == 4 and of(4) == 7
    e.update(frame(spark, [(0, ("Tim", "t"))]))
    assert e.save(folder) == 5 and of(5) == 7
    SearchEngine.vacuum(spark, folder)
    assert [p.name for p in (tmp_path / "e").iterdir()] == ["v000000005"]


@pytest.mark.parametrize("most", [0, 1 << 20])
def test_deleting_few_ids_doesnt_shuffle_postings(spark, monkeypatch, most):
    monkeypatch.setattr(ix, "BROADCAST_BYTES", most)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        e = SearchEngine(spark, frame(spark, enumerate(USERS)), stemming=False, stop_words=False)
        e.delete(["3", "5"])
        assert ("BroadcastHashJoin" in e.index.postings._jdf.queryExecution().executedPlan().toString()) == (most > 0)
        assert table(e) == table(SearchEngine(spark, frame(spark, [(k, v) for k, v in enumerate(USERS) if k not in (3, 5)]), stemming=False, stop_words=False))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_tables_stored_are_as_they_were(spark):
    from quernstone.storage import stored

    odd = spark.sql("select 1 as a, 'x' as A, cast(null as string) as `b.c d`, double('nan') as `a`, array(1) as e")
    for df in (odd, odd.drop("e")):
        got = stored(df)
        assert got.columns == df.columns and [f.dataType for f in got.schema] == [f.dataType for f in df.schema] and str(got.collect()) == str(df.collect())


def test_the_tree_query_computes_its_dictionary_once(spark):
    from quernstone.queries import QUERIES

    plan = QUERIES["match_fuzzy_tree"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate posexplode" not in plan and "split(" not in plan
