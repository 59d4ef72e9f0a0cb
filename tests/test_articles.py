"""Front matter by id, stated dates, chunks of articles with the titles of their sections, and the table function of chunks."""

import random

import pytest
from pyspark.sql import functions as F

from evidentia.operators import chunking
from evidentia.sources import articles

HEAD = """<?xml version="1.0"?>{0}<article article-type="{1}"><front><journal-meta><journal-title>Shore &amp; Sea</journal-title></journal-meta><article-meta>
<article-id pub-id-type="doi">10.1/{2}</article-id><article-id pub-id-type="doi">10.1/second</article-id><article-id pub-id-type="pmcid">{2}</article-id>
<title-group><article-title>On   <i>tides</i> {2}</article-title></title-group>{3}
<permissions><license xmlns:xlink="http://www.w3.org/1999/xlink" xlink:href="https://a.org/by"><p>Open.</p></license></permissions></article-meta></front>"""
DATE = '<pub-date pub-type="{}"><year>{}</year><month>{}</month><day>{}</day></pub-date>'


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("articles")
    for k in range(40):
        date = DATE.format("ppub", 2019, 1, 5) + DATE.format("epub", 2020, 3, 7) if k % 2 else DATE.format("print", 998, 11, "x")
        (at / f"PMC{k}.xml").write_text(HEAD.format("", "research-article", k, date) + f"<body><sec><title>Part</title><p>Text {k}.</p></sec></body></article>")
    # The front matter is whole, what follows is not; a set around the article; a file that is none.
    (at / "PMC100.xml").write_text(HEAD.format("", "review", "PMC100", "") + "<body><sec><p>never closed & not even XML" + "<" * 40_000)
    (at / "PMC101.xml").write_text(HEAD.format("<set>", "letter", 101, "<pub-date><year>2001</year></pub-date>") + "<body/></article></set>")
    (at / "PMC102.xml").write_text("<set><Error>not found</Error></set>")
    (at / "PMC103.xml").write_text("<article><front><article-meta/></front></article>")
    (at / "notes.txt").write_text("no article")
    return str(at)


def test_front_matter_is_read_without_bodies(spark, folder):
    rows = {r.path.rsplit("/", 1)[-1]: r for r in articles.read_front_matter(spark, folder).collect()}
    assert len(rows) == 44
    whole = rows["PMC100.xml"]
    assert (whole.pmcid, whole.doi, whole.title, whole.journal, whole.article_type, whole.license_url, whole.pub_date, whole.error) == ("PMC100", "10.1/PMC100", "On tides PMC100", "Shore & Sea", "review", "https://a.org/by", "", None)
    assert rows["PMC7.xml"].pub_date == "2020-03-07" and rows["PMC8.xml"].pub_date == "0998-11" and rows["PMC101.xml"].pub_date == "2001"
    assert rows["PMC102.xml"].error == "no article" and rows["PMC103.xml"].error == "no pmcid" and rows["PMC103.xml"].pmcid is None
    # The whole article says the same, where it can be read whole.
    full = {r.pmcid: r for r in articles.read_articles(spark, folder).filter("error IS NULL").collect()}
    assert "PMC100" not in full and len(full) == 40
    for name, r in full.items():
        head = rows[f"{name}.xml"]
        assert all(r[c] == head[c] for c in ("pmcid", "doi", "title", "journal", "pub_date", "article_type", "license_url"))


def test_lookup_by_id_opens_no_other_file(spark, folder):
    found = articles.read_front_matter(spark, folder, ["PMC3", "PMC100", "PMC999"])
    assert sorted(r.pmcid for r in found.collect()) == ["PMC100", "PMC3"]
    assert articles.read_front_matter(spark, folder, []).count() == 0
    reader = articles.FrontMatterReader(folder, 200)
    list(reader.pushFilters([articles.In(("pmcid",), ("PMC3", "PMC4", "PMC999")), articles.EqualTo(("pmcid",), "PMC4"), articles.EqualTo(("title",), "x")]))
    assert [name.rsplit("/", 1)[-1] for part in reader.partitions() for name in part.names] == ["PMC4.xml"]
    assert [len(p.names) for p in articles.FrontMatterReader(folder, 30).partitions()] == [30, 14]


def test_dates_as_they_stand(spark):
    date = lambda *rows: spark.createDataFrame([(list(rows),)], "dates array<struct<kind:string,year:string,month:string,day:string>>").select(articles.iso_date(F.col("dates")).alias("x")).first().x
    assert date() == "" and date(("x", None, "2", "3")) == "" and date(("x", "12345", "3", "123")) == "12345-03-123"
    assert date(("pub", "2001", "1", "1"), ("collection", "2002", None, "9"), ("epub", "2003", "may", "9")) == "2003"
    assert date(("other", "2000", "7", None), ("pub", "", "1", "1")) == "" and date(("other", "2000", "7", None)) == "2000-07"


def test_ids_as_they_stand(spark):
    ids = spark.createDataFrame([([("doi", ""), ("pmid", "7"), ("pmid", "8")],)], "ids array<struct<kind:string,value:string>>")
    assert tuple(ids.select(*(articles.first_id(F.col("ids"), k) for k in ("doi", "pmid", "none"))).first()) == (None, "7", None)


def test_overlapped_titles_equal_brute_force():
    rng = random.Random(9)
    for _ in range(300):
        n = rng.randint(1, 60)
        cut = lambda: sorted(rng.sample(range(n + 1), 2)) if n else [0, 0]
        sections = [(rng.choice(["A", "B", "", "C"]), *cut()) for _ in range(rng.randint(0, 12))]
        spans = sorted(tuple(cut()) for _ in range(rng.randint(0, 12)))
        plain = [list(dict.fromkeys(t for t, s, e in sections if t and s < b and e > a)) for a, b in spans]
        assert articles.overlapped(sections, spans) == plain


def nested(rng, depth=0):
    blocks = "".join(f"<p>{' '.join(rng.choices(['tide', 'moon.', 'shore', 'salt'], k=rng.randint(1, 30)))}</p>" for _ in range(rng.randint(0, 2)))
    inner = "".join(nested(rng, depth + 1) for _ in range(rng.randint(0, 2))) if depth < 3 else ""
    return f"<sec><title>{rng.choice(['Results', 'Methods', 'Notes', ''])}</title>{blocks}{inner}</sec>"


def test_from_xml_to_chunks_with_section_titles(spark, tmp_path):
    rng = random.Random(2)
    for k in range(12):
        (tmp_path / f"PMC{k}.xml").write_text(HEAD.format("", "research-article", k, "") + f"<body><p>Lead {k}.</p>{''.join(nested(rng) for _ in range(3))}</body></article>")
    (tmp_path / "PMC50.xml").write_text("<article>")
    parsed = articles.read_articles(spark, str(tmp_path)).cache()
    chunks = articles.chunk_articles(parsed, lambda text: chunking.fixed_pieces(text, 12, 3)).collect()
    whole = {r.pmcid: r for r in parsed.filter("error IS NULL").collect()}
    assert {c.pmcid for c in chunks} == set(whole) and len(whole) == 12
    seen = 0
    for c in chunks:
        a = whole[c.pmcid]
        assert a.body[c.char_start : c.char_end] == c.text == c.text.strip() and c.n_tokens == len(c.text.split())
        plain = list(dict.fromkeys(s.title for s in a.sections if s.title and s.char_start < c.char_end and s.char_end > c.char_start))
        assert c.titles == plain
        seen = max(seen, len(plain))
    assert seen > 1
    for pmcid in whole:
        assert [c.chunk_index for c in chunks if c.pmcid == pmcid] == list(range(sum(c.pmcid == pmcid for c in chunks)))


def test_chunks_as_a_table_function(spark):
    rng = random.Random(3)
    texts = [None, "", "  ", *("".join(rng.choice(["word ", "two words. ", "\n", "\n\n", "x"]) for _ in range(200)) for _ in range(5))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.createOrReplaceTempView("texts_to_cut")
    chunking.register_chunk_table(spark)
    by_sql = spark.sql("SELECT t.doc_id, c.chunk_index, c.n_tokens, c.char_start, c.char_end, c.level, c.text FROM texts_to_cut t, LATERAL recursive_chunks(t.text, 9) c")
    plain = chunking.recursive_chunks(docs, 9).select("doc_id", "chunk_index", "n_tokens", "char_start", "char_end", "level", "text")
    assert sorted(map(tuple, by_sql.collect())) == sorted(map(tuple, plain.collect())) != []


def test_tokens_between_offsets():
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choice("ab \n") for _ in range(rng.randint(0, 30)))
        tokens = chunking.Tokens(text)
        a = rng.randint(0, len(text))
        b = rng.randint(a, len(text))
        found = [m.span() for m in chunking._TOKEN.finditer(text, a, b)]
        assert tokens.spans(a, b) == found and tokens.count(a, b) == len(found)
