from quire.llm import ocr


def reader():
    counts = {"of": 900, "in": 700, "survey": 50, "operations": 50, "the": 900}
    return ocr.Reader(counts, {}, set(), {"survey", "of", "operations"})


def test_two_letter_words_with_a_digit_are_misread_words():
    assert reader().correct("0f", ["survey"], "") == "of" and reader().correct("1n", ["survey"], "") == "in"
    noise, _ = reader().read(["the survey 0f the operations", "in the survey of the operations"], [0.5, 0.5])
    assert noise == [{"characters"}, set()]


def test_two_letter_words_in_headers():
    noise, _ = reader().read(["Survey 0f Operations", "Survey of Operations"], [0.05, 0.05])
    assert noise == [{"header", "characters"}, {"header"}]


def test_quarters_numbers_and_signs_of_two_characters_stay():
    assert all(reader().correct(t, [], "") is None for t in ("Q2", "H1", "m²", "n°", "5%", "2x", "of", "42"))
