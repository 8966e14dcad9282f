from lodestar.llm import language


def test_rare_languages_are_learned(spark):
    rows = [(i, "the cat and the dog", "en") for i in range(3000)] + [(10_000 + i, "kissa ja koira", "fi") for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for sample in (5, 50, language.SAMPLE):
        model = language.train(docs, sample)
        assert model.names == ["en", "fi"]
        assert model.predict("kissa ja koira")[0] == "fi" and model.predict("the dog")[0] == "en"
