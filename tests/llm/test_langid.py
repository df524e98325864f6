import zlib

from tessera.llm import langid

DIR = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = langid.op10_language(spark, DIR).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "lang").collect()}
    assert len(got) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    out = [r for r in got if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in out) >= 0.95 * len(out)
    sure = [r for r in out if not r.rejected]
    assert sum(r.lang_pred == lang[r.doc_id] for r in sure) >= sum(r.lang_pred == lang[r.doc_id] for r in out) / len(out) * len(sure)


def test_cases(spark):
    en, fr = "the cat and the dog were in the house with that thing ", "le chat et le chien sont dans la maison avec cette chose "
    train = [(i, (en if i % 2 else fr) * 3 + str(i), "en" if i % 2 else "fr", 1.0) for i in range(1, 40)] + [(90, None, "xx", 1.0), (91, "text", None, 1.0)]
    docs = spark.createDataFrame(train, "doc_id long, text string, lang string, score double")
    model = langid.fit_languages(docs)
    assert set(model.dictionaries) == {"en", "fr"}
    cases = [(1, "the dog and the cat", "x", 1.0), (2, "LE CHIEN ET LE CHAT", None, 1.0), (3, None, "en", 1.0), (4, "", "en", 1.0), (5, "123 !!", "en", 1.0), (None, en * 5000, None, 1.0), (1, "the dog and the cat", "x", 1.0)]
    got = langid.identify(spark.createDataFrame(cases, docs.schema), model).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 7 and by[1].lang_pred == "en" and by[2].lang_pred == "fr" and by[None].lang_pred == "en"
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (3, 4, 5))
    assert langid.identify(docs.limit(0), model).collect() == []
    assert langid.identify(docs, langid.fit_languages(docs.limit(0))).select("lang_pred").distinct().collect()[0][0] == "und"


def test_predictions_equal_a_plain_reckoning(spark):
    """Every dictionary, every block, in plain loops."""
    import zstandard as z

    docs = spark.read.parquet(f"{DIR}/documents.parquet").where("doc_id % 3 = 0")
    model = langid.fit_languages(docs)
    assert all(0 < len(d) <= langid.DICTIONARY_BYTES for d in model.dictionaries.values())
    settings = z.ZstdCompressionParameters.from_level(3, min_match=3, strategy=z.STRATEGY_GREEDY, write_content_size=0, write_checksum=0, write_dict_id=0)
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    for r in docs.collect():
        letters = " ".join("".join(c if c.isalpha() else " " for c in (r.text or "").lower()).split())
        if not letters:
            assert got[r.doc_id].lang_pred == "und"
            continue
        data, sizes = f" {letters} ".encode(), {}
        for lang, d in model.dictionaries.items():
            enc = z.ZstdCompressor(dict_data=z.ZstdCompressionDict(d, dict_type=z.DICT_TYPE_RAWCONTENT), compression_params=settings)
            sizes[lang] = sum(len(enc.compress(data[a : a + langid.BLOCK])) for a in range(0, len(data), langid.BLOCK))
        best = min(sizes.values())
        assert sizes[got[r.doc_id].lang_pred] == best
        assert abs(got[r.doc_id].score - 1 / sum(2.0 ** (best - v) for v in sizes.values())) < 1e-9


def test_shares_come_from_all_over_a_text():
    text = " ".join(f"{'abcdefghij'[i // 10000]}{chr(97 + i % 26)}word" for i in range(100_000))
    got = langid.share(text)
    assert len(got) <= langid.DICTIONARY_BYTES // (langid.BUCKETS * langid.PER_BUCKET)
    assert {w[0] for w in got.decode().split() if w.endswith("word") and len(w) == 6} >= {"a", "d", "g", "j"}
    assert langid.share("Short text") == b" short text "


def test_most_frequent_languages_are_learned(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 2)
    docs = spark.createDataFrame([("some text here", lang) for lang in "aaabbc"], "text string, lang string")
    assert set(langid.fit_languages(docs).dictionaries) == {"a", "b"}
