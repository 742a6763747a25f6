import pytest
from mirrorsift.llm import licenses
from mirrorsift.llm.common import word_hashes

INDEX = licenses.Index(licenses.TEMPLATES)
NOTICE = licenses.TEMPLATES["MIT-line"]


def scan(text):
    return [(name, text[b:e]) for name, _, b, e in licenses.scan_text(text, word_hashes(licenses._words(text)), INDEX)]


@pytest.mark.parametrize("gap", [0, 1, 3, 7, 8, 30])
def test_each_repeat_of_a_short_notice_counts(gap):
    title = " ".join(f"title{i}" for i in range(gap))
    assert scan("\n".join(f"{title} {NOTICE}" for _ in range(200))) == [("MIT-line", NOTICE)] * 200


def test_changed_neighbours_stay_apart():
    text = "Released under MIT License. A b c Released under the MIT License. Released under the License. D Released under MIT License."
    assert [t for _, t in scan(text)] == ["Released under MIT License.", NOTICE, "Released under the License.", "Released under MIT License."]


def test_stray_grams_do_not_move_a_long_notice():
    long = licenses.TEMPLATES["MIT"]
    words = long.split()
    # grams of the notice's end and begin around it, each 11 words off the last diagonal
    strays = " ".join(" ".join(words[:3] + [f"s{i}x{k}" for k in range(8)]) for i in range(8))
    assert ("MIT", long) in scan(f"{strays} {long} {strays}")


def test_line_notice_beside_the_long_one():
    text = f"{licenses.TEMPLATES['Apache-2.0']} {licenses.TEMPLATES['Apache-2.0-line']}"
    assert [n for n, _ in scan(text)] == ["Apache-2.0", "Apache-2.0-line"]
