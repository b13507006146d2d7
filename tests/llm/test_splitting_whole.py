from caselode.llm import splitting as s


def test_a_boundary_before_a_long_token_is_used():
    text = "Sequence of the sample follows.\n\n" + "ACGT" * 40
    (a, b, _, level), *rest = s.pieces(text, "chars", 100, 10)
    assert text[a:b].endswith("\n\n") and level == s.PARAGRAPH
    assert rest[-1][1] == len(text) and all(size <= 100 for _, _, size, _ in [(a, b, b - a, level), *rest])
    (a, b, _, level), *_ = s.pieces(text, "bytes", 100, 10)
    assert text[a:b].endswith("\n\n") and level == s.PARAGRAPH


def test_no_word_is_cut_that_a_boundary_could_save():
    text = "Intro. " + "x" * 70 + " end of it " + "y" * 300 + " and more words here"
    for overlap in (0, 5, 20):
        at = s.strengths(text)[0]
        found = s.pieces(text, "chars", 80, overlap)
        last = 0
        for a, b, _, level in found[:-1]:
            assert level > s.NONE or not (at[max(a + overlap, last) + 1 : a + 81] > s.NONE).any()
            last = b


def test_each_step_goes_on_without_boundaries():
    found = s.pieces("a\n" + "x" * 1000, "chars", 50, 40)
    assert found[-1][1] == 1002 and all(c > a for (a, *_), (c, *_) in zip(found, found[1:]))
