import pytest

from strandlake.llm import pii


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("IBAN DE89 3704 0044 0532 0130 00 BIC COBADEFF", ["DE89 3704 0044 0532 0130 00"]),
        ("DE89370400440532013000 EUR 50", ["DE89370400440532013000"]),
        ("GB82WEST12345698765432 I said", ["GB82WEST12345698765432"]),
        ("DE89370400440532013000 GB82WEST12345698765432 A", ["DE89370400440532013000", "GB82WEST12345698765432"]),
        ("AB12 DE89370400440532013000", ["DE89370400440532013000"]),
        ("DE88370400440532013000 EUR 50", []),
    ],
)
def test_ibans_end_where_their_checksum_holds(text, want):
    assert [text[s:e] for s, k, e in pii.spans(text)[1] if k == 4] == want
