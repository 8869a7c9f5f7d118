"""Comments inside headers of formats 1.5 to 2.9."""

from stowage.functions import formats as A
from stowage.functions import lzold
from stowage.operators.comments import decode_comment


def test_nested_comments():
    text = b"a comment that says a comment"
    packed = A.comment15(text, lzold.encode(text, lzold.V20), 20)
    data = A.write15([{"name": b"a", "payload": b"one"}, {"name": b"b", "payload": b"two", "comment": packed}], comment=A.comment15(text))
    blocks = list(A.parse(data))
    assert all(x["header_ok"] for x in blocks) and [x["kind"] for x in blocks] == ["main", "file", "file", "end"]
    found = list(A.comments15(data))
    assert [n for n, _ in found] == [None, 1] and all(c["header_ok"] for _, c in found)
    assert [decode_comment(c) for _, c in found] == [(text, "whole")] * 2
    changed = data.replace(text, text[:-1] + b"!")
    assert all(x["header_ok"] for x in A.parse(changed))  # a header's check value leaves its comment out
    assert decode_comment(next(A.comments15(changed))[1]) == (None, "damaged")
    assert decode_comment(found[1][1] | {"version": 15}) == (None, "unsupported")
    assert list(A.comments15(A.write15([{"name": b"a"}]))) == [] and list(A.comments15(b"")) == []
