from citeloom.llm import scans as S

CLEAN = "The officer opened the loading dock and the trial court granted the cross-examination transcript without a receipt at the grain elevator in 1946. The hearing examiner saw a burner telephone within 50 yards of the house. "
PAGE = """The offi-
cer 0pened the loading clock and the frial court granted the
cross-
examination tran·script without a receipt at the gra!n elevat0r
in |946. The hearing exarniner saw a bumer telephone within S0
[12]
DOE HOLDINGS V. ROE COMPANY
yards of the house. The officer opened the loading dock and the trial
court granted the transcript at the grain elevator. The hearing ware¬

Page 13 of 20
Cite as: 5 Vell. Rep. 7

house saw a burner telephone within fifty yards of the house today.
"""


def frame(spark):
    rows = [(i, CLEAN * 30 + " warehouse" * 40) for i in range(100, 104)] + [(1, PAGE), (1, PAGE), (2, None), (3, ""), (4, "\n".join(["x" * 60] * 3))]
    return spark.createDataFrame([(*r, "n") for r in rows], "row_id bigint, plain_text string, kind string")


def test_repairs(spark):
    got = {(r["kind"], r["repaired"]) for r in S.repairs(frame(spark)).filter("row_id = 1").collect()}
    assert {x for k, x in got if k == "furniture"} == {"[12]", "DOE HOLDINGS V. ROE COMPANY", "Page 13 of 20", "Cite as: 5 Vell. Rep. 7"}
    assert {x for k, x in got if k == "hyphen"} == {"officer", "cross-examination", "warehouse"}
    assert {x for k, x in got if k == "char"} == {"opened", "dock", "trial", "transcript", "grain", "elevator", "1946", "examiner", "burner", "50"}


def test_only_scans_and_each_repair_once(spark):
    rows = [tuple(r) for r in S.repairs(frame(spark)).collect()]
    assert {r[0] for r in rows} == {1} and len(rows) == len(set(rows))
    assert S.repairs(frame(spark).limit(0)).count() == 0


def test_candidates_and_numbers():
    assert "dock" in S.candidates("clock") and "inside" in S.candidates("insicle") and "called" in S.candidates("c@ll·ed")
    assert S.number_of("s82") == "582" and S.number_of("|02") == "102" and S.number_of("2d") is None and S.number_of("so") is None and S.number_of("l973") == "1973"
    assert S.candidates("x" * 100) == {}


def test_page_furniture_spares_headings_and_text():
    lines = ["II. DISCUSSION", "", "The court held that the search of the vehicle was lawful and that", "the motion had to be denied for the reasons that follow below here.", "- 4 -", "OPINION OF THE COURT", "It follows that the judgment is affirmed in part and that the case is", "remanded for a new trial on the second count of the complaint filed."] * 2
    assert {lines[i] for i in S.furniture(lines)} == {"- 4 -", "OPINION OF THE COURT"}
    assert S.furniture([]) == set() and S.furniture(["", " "]) == set()


def test_viterbi_prefers_what_the_corpus_writes():
    count = {"within": 10, "yards": 10, "0": 500, "within 0": 9, "0 yards": 9, "so": 5}
    assert S.decode([["within"], ["50", "so"], ["yards"]], [[0.0], [-0.7, -0.05], [0.0]], count, 10_000)[1] == "50"


def test_texts_run_on_corrected(spark):
    got = {r["row_id"]: r["repaired_text"] for r in S.repaired_texts(frame(spark).distinct()).collect()}
    assert got == {1: (
        "The officer opened the loading dock and the trial court granted the cross-examination transcript without a receipt at the grain elevator in 1946. "
        "The hearing examiner saw a burner telephone within 50 yards of the house. The officer opened the loading dock and the trial court granted the transcript at the grain elevator. "
        "The hearing warehouse saw a burner telephone within fifty yards of the house today."
    )}
    assert S.repaired_texts(frame(spark).limit(0)).count() == 0


def test_long_tokens_and_many_signs_have_candidates_too():
    long = "antidisestablishmentarianism" * 2
    assert long in S.candidates(long.replace("i", "!", 7)) and long in S.candidates("·" * 30 + long)


def test_paragraphs_survive_but_not_those_that_a_page_end_makes():
    lines = ["The first paragraph of the text runs over two lines and it ends", "here.", "", "The second one is broken off by the end of the page where the", "", "Page 4 of 9", "", "next page goes on.", "", "   A third one."]
    assert S.rebuilt("\n".join(lines), {}) == "The first paragraph of the text runs over two lines and it ends here.\n\nThe second one is broken off by the end of the page where the next page goes on.\n\nA third one."
