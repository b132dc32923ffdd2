import numpy as np
import pytest

from spotframe.llm import quality

WORDS = ["the", "of", "and", "to", "is", "was", "that", "a", "de", "para"]
PROSE = "The court below found that the lease was worth no more than nothing, and the claimant was to pay the costs of it. " * 4


def run(spark, texts):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, kind string")
    common = spark.createDataFrame([(w,) for w in WORDS], "word string")
    return {r.doc_id: r for r in quality.text_quality(docs, common).collect()}


def test_line_statistics_match_plain_counts():
    common, binders = quality.hash_words(WORDS), quality.hash_words(["de", "of"])
    texts = ["The Cat of Paris, 12 dogs.\n\n• item one;\n\ta\tb", None, "", "x\r\ny", "çà ét\n$$ %%"]
    n = quality.Lines(texts, common, binders)
    assert n.doc.tolist() == [0, 0, 0, 0, 1, 2, 3, 3, 4, 4]
    assert n.chars.tolist() == [21, 0, 9, 2, 0, 0, 1, 1, 5, 4]
    assert n.words.tolist() == [5, 0, 2, 2, 0, 0, 1, 1, 2, 0]
    assert n.common.tolist() == [2, 0, 0, 1, 0, 0, 0, 0, 0, 0] and n.joining.tolist()[0] == 1
    assert n.tabs.tolist()[3] == 2 and n.bulleted.tolist()[2] and n.terminal.tolist()[0]
    assert n.symbols.tolist()[9] == 2 and n.longest.tolist()[9] == 2


def test_kinds(spark):
    got = run(
        spark,
        [
            PROSE,
            "\n".join(f"({c}) receipt minor, {i} June 2010," for i, c in enumerate("abcdefgh", 1)),
            "\n".join(f"{i}\tnotice\tOldmere\t{i * 7}" for i in range(1, 9)),
            "\n".join("e81b 7364 a141 93bf 8a32 ab4f 9e32 d26b" for _ in range(8)),
            "\n".join(["Log in", "Top of page ^", "Home > Decisions"] * 5),
            "\n".join(["Dalfenaire Holding", "E. Iznarard", "Brineldow Works", "T. Narvarard"]),
            "1. " + PROSE + "\n2. " + PROSE,
            PROSE.upper(),
            "x" * 300_000,
        ],
    )
    assert [got[i].kind for i in range(9)] == [None, "list", "table", "junk", "junk", "list", None, None, "junk"]
    assert got[0].reasons == [] and "junk" in got[3].reasons and "few_terminal_lines" in got[2].reasons


def test_null_empty_and_repeated(spark):
    got = run(spark, [None, "", " \n ", "​", PROSE, PROSE])
    assert all(got[i].kind is None and "too_few_words" in got[i].reasons for i in range(4))
    a, b = got[4].asDict(), got[5].asDict()
    assert {**a, "doc_id": 0} == {**b, "doc_id": 0} and a["n_words"] == len(PROSE.split())
    assert a["mean_word_length"] == pytest.approx(np.mean([len(w.strip(",.")) for w in PROSE.split()]))


def test_empty_tables(spark):
    assert run(spark, []) == {}
    docs = spark.createDataFrame([(1, PROSE)], "doc_id long, text string")
    assert quality.text_quality(docs, spark.createDataFrame([], "word string")).first().n_stop_words == 0


def test_batches_do_not_change_statistics():
    common = quality.hash_words(WORDS)
    texts = [PROSE, "a\nb", None, "• x y\n• z w\n• u v", PROSE.upper()]
    whole = quality._stats(texts, common, common)
    single = [quality._stats([t], common, common) for t in texts]
    assert all(np.allclose(whole[k], np.concatenate([s[k] for s in single])) for k in whole)


def test_published_rules(spark):
    got = run(spark, ["the the the " + "word " * 60, "a 12 34 5 of", "same line\nsame line\nother", None])
    assert got[0].n_stop_words == 1 and "few_stop_words" in got[0].reasons and got[0].n_words == 63
    assert got[1].alpha_share == pytest.approx(0.4) and "few_alphabetic_tokens" in got[1].reasons and got[1].n_stop_words == 2
    assert got[2].repeated_char_share == pytest.approx(16 / 21) and {"repeated_lines", "short_lines"} <= set(got[2].reasons)
    assert got[3].alpha_share == 0 and got[3].short_line_share == 0
