"""Line rules on lines of every length."""

from gradeloom.llm.line_rules import judge, line_fails


def fails(line):
    return line_fails(line.encode(), len(line.split()))


def test_notices_and_menus_of_any_length():
    words = " ".join(f"word{i}" for i in range(40))
    assert fails(f"By using this site you accept the use of cookies {words}.") == "boilerplate"
    assert fails(" | ".join(f"Page{i}" for i in range(40)) + ".") == "navigation"
    assert fails(f"Our privacy policy is short. {words}.") is None  # a text on one line survives a mention
    assert fails(f"{words}. All rights reserved.") is None


def test_fragments_without_punctuation():
    for n in (5, 12, 29, 30, 60):
        assert fails(" ".join(f"word{i}" for i in range(n))) == "punctuation", n
    assert fails("only four words here") is None
    assert fails("Some words about the plain harbour.") is None
    for line in ("- milk and bread and more eggs", "2. take the road to the left", "b) all of the other ones", "## what is in this part", "1.2 words of a numbered heading", "The Rules of the Long Road", "WHAT TO DO IN A STORM", "    return a if b else c", "total = a + b + c"):
        assert fails(line) is None, line
    pieces = "\n".join(" ".join(f"w{i}x{k}" for k in range(29)) for i in range(5))
    assert not judge(pieces)["base_failed"] and not judge(pieces)["kept"]
