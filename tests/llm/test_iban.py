import pytest
from mirrorsift.llm import pii

DE, GB = "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32"


@pytest.mark.parametrize("text, want", [
    (f"IBAN {DE} BIC COBADEFFXXX", [DE]), (f"IBAN {DE.replace(' ', '')} BIC X", [DE.replace(" ", "")]), (f"{GB} AND {DE} OK", [GB, DE]),
    (f"REF AB12 CODE {DE} EUR", [DE]), (f"account {DE}.", [DE]), ("DE00 1234 5678 9012 3456 78 BIC", []),
])
def test_account_numbers_before_words_in_capitals(text, want):
    spans = [s.split(":") for s in pii.digest(text)[5].split(",") if s.startswith("iban")]
    assert [text[int(b) : int(e)] for _, b, e in spans] == want
