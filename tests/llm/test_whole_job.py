"""Operators over whole texts: what is far off, short or misspelt counts too."""

from pyspark.sql import functions as F

from touchline.llm import privacy, toxicity


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_telling_terms_count_wherever_they_stand(spark):
    filler = "the weather holds and again the called ones come here " * 4
    rows = [(i, f"Zorblax {filler}zorblax, {filler}write to me@x.org {filler}李明 and{'' if i % 2 else ' 1'} Bob", "a") for i in range(4)]
    rows += [(10 + i, f"{filler}x{i}@y.org", "a") for i in range(30)]
    found = privacy.find_personal_data(docs(spark, rows))
    joined = found.join(docs(spark, rows).select("doc_id", "text"), "doc_id")
    got = {r["doc_id"]: r["t"] for r in joined.select("doc_id", privacy.sanitised(F.col("text"), F.col("base"), F.col("added")).alias("t")).collect()}
    for i in range(4):
        assert got[i] == f" {filler}, {filler}  <EMAIL> {filler} and{'' if i % 2 else ' 1'} "
    assert all(got[10 + i] == f"{filler}<EMAIL>" for i in range(30))


def test_misspellings_inside_stems_of_short_terms_and_with_signs(spark):
    forms = ["stupid", "stupidity", "stupidly"]
    rows, labels = [], []
    for i in range(1, 601):
        toxic = i % 3 == 0
        extra = f" you {forms[i % 9 // 3]} scum" + (" skum" if i % 2 else "") if toxic else ""
        rows.append((i, f"the weather holds and again the called ones come here {i % 7}" + extra, "a"))
        labels.append((i, int(toxic)))
    df, lab = docs(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    lexicon = toxicity.learn_lexicon(toxicity.labelled_sample(df, lab, "doc_id", "text"))
    stem = next(t for t, is_stem in lexicon.terms if is_stem)
    scorer = toxicity.Scorer(lexicon)
    assert "stupid".startswith(stem) and lexicon.words["stupidity"] == stem
    assert scorer.hits({"stupidity"}) == {"stupidity": (stem, 0)}
    assert scorer.hits({"sxupid"}) == {"sxupid": (stem, 1)}
    assert scorer.read("such sc*m")[2] == {"sc*m": ("scum", toxicity.MARKED)}
    assert scorer.read("st1pid it's")[2] == {"st1pid": (stem, 1)}
    assert scorer.features("such sc*m here")[1] > 0 == scorer.features("such a here it's")[1]


def test_loose_automaton_edits_the_first_letter_and_four_letter_terms():
    auto = toxicity.LexiconAutomaton([("idiot", False), ("scum", False), ("disgusting", False)], toxicity.LOOSE_EDITS, first=True)
    assert [auto.match(w) for w in ("adiot", "diot", "xidiot", "skum", "cum", "xisgustng")] == [("idiot", 1)] * 3 + [("scum", 1)] * 2 + [("disgusting", 2)]
    assert [auto.match(w) for w in ("adiit", "skun", "the")] == [None] * 3
