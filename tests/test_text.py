"""Golden fixtures for the text operators (FIXTURES.md Y1-Y4)."""

from pyspark.sql import functions as F

from cohera.functions.text import normalize, split_sentences, tokenize

# The review of fixture Y1, a plain input (fixed value).
Y1 = ("This screen protector is a great value and very well made.<br /><p />I am 5'9'' so far, "
      "but this one does not look like that big of an improvement from previous generations..."
      "it just feels more solid than before with no scratches or anything else on either side.")


def _one(spark, expr, text):
    return spark.createDataFrame([(text,)], "t string").select(expr(F.col("t")).alias("x")).first()["x"]


def test_y1_sentence_splitter(spark):
    got = _one(spark, lambda c: split_sentences(c, keep_tail=False), Y1)
    assert got == [
        "This screen protector is a great value and very well made.",
        "<br /><p />I am 5'9'' so far, but this one does not look like that big of an improvement "
        "from previous generations.",
        ".", ".",
        "it just feels more solid than before with no scratches or anything else on either side."]


def test_y2_unterminated_tail(spark):
    t = "A + soft and nice to touch"
    assert _one(spark, lambda c: split_sentences(c, keep_tail=False), t) == []
    assert _one(spark, lambda c: split_sentences(c, keep_tail=True), t) == [t]


def test_splitter_protections(spark):
    got = _one(spark, split_sentences, "Dr. Smith paid 3.5 dollars at example.com today. He left!")
    assert got == ["Dr. Smith paid 3.5 dollars at example.com today.", "He left!"]


def test_y3_y4_tagged_normalisation(spark):
    assert _one(spark, lambda c: normalize(c, "tagged"), "") == "<s></s>"
    assert _one(spark, lambda c: normalize(c, "tagged"), "The Cat, 9") == "<s>the cat </s>"
    assert _one(spark, lambda c: normalize(c, "plain"), "  <s>The Cat</s> ") == "the cat"
    assert _one(spark, lambda c: normalize(c, "cased"), "  <s>The Cat</s> ") == "The Cat"


def test_tokenisers(spark):
    assert _one(spark, lambda c: tokenize(c, "whitespace"), "  a  b\tc ") == ["a", "b", "c"]
    assert _one(spark, lambda c: tokenize(c, "strip_ends"), "<s>a b c</s>") == ["b"]
    assert _one(spark, lambda c: tokenize(c, "simple"), "Café x déjà_vu 42 abc") == ["cafe", "deja_vu", "abc"]


def test_python_white_space(spark):
    t = " a b\x85c\x1cd 　e​f\n"
    assert _one(spark, lambda c: tokenize(c, "whitespace"), t) == t.split()
    assert _one(spark, lambda c: normalize(c, "plain"), t) == t.strip().lower()


def test_every_document_keeps_a_keyword_row(spark):
    from cohera.operators import keywords as KW
    d = spark.createDataFrame([("a", "river stone stone"), ("b", "That it."), ("c", "")], "id string, text string")
    idf, w = KW.fit_transform_weights(d, "id", "text")
    got = {r.id: r.keywords for r in KW.top_keywords(w, "id", 10, docs=d).collect()}
    assert got == {"a": " stone river", "b": "", "c": ""}
    assert {r.id: r.keywords for r in KW.transform_keywords(d, idf, "id", "text").collect()} == got


def test_tagged_words_are_read_off_the_kept_runs(spark):
    """The definition (delete tags, rewrite what lies between runs, wrap, split) on
    odd sentences; the plan must not look for the characters between the runs."""
    from cohera.functions.text import py_strip, tokenize

    odd = ["", " ", "123", "a", "The Cat, 9", "9 a b. 9", "<s>a</s>", "<<s>/s>", "<</s>s>x", "a</s", "s>a</s></s", "ÀB c\x1cd", "İx\ny", "e!?@.f", "</s>\n", "a<s>b</s>c", None]
    df = spark.createDataFrame([(x,) for x in odd], "c string")
    base = F.regexp_replace(py_strip(F.lower("c")), "(<s>|</s>)", "")
    plain = F.concat(F.lit("<s>"), F.regexp_replace(base, "[^a-zA-Z.!?@]+", " "), F.lit("</s>"))
    out = df.select(plain.alias("a"), normalize("c", "tagged").alias("b"), tokenize(plain).alias("x"), tokenize("c", "tagged").alias("y"))
    for r in out.collect():
        assert r.a == r.b and r.x == r.y, r
    assert "[^a-zA-Z" not in df.select(tokenize("c", "tagged"))._jdf.queryExecution().toString()
