"""The commands and their exit codes."""

import io
import os

from stowage.__main__ import CHECKSUM, DONE, NO_FILES, USAGE, run
from stowage.functions import formats as A
from stowage.functions import inline


def test_commands(spark, tmp_path):
    data = inline.protect(A.write50([{"name": b"a/one.txt", "payload": b"first\n"}, {"name": b"b/two.txt", "payload": b"second\n" * 900}]), 50)
    source = tmp_path / "in"
    source.mkdir()
    (source / "x.rar").write_bytes(data)

    def call(*arguments):
        out = io.StringIO()
        return run(spark, list(map(str, arguments)), out), out.getvalue()

    assert call("lb", source) == (DONE, "a/one.txt\nb/two.txt\n")
    code, text = call("l", source, "*one*")
    assert code == DONE and text.split("\t")[1:4] == ["a/one.txt", "6", "6"]
    assert call("t", source) == (DONE, "OK\t2\n")
    assert call("p", source, "*one*") == (DONE, "first\n")
    assert call("lb", source, "none*")[0] == call("x", source, "none*", "--to", tmp_path / "no")[0] == NO_FILES
    assert call("what", source)[0] == USAGE
    out = tmp_path / "out"
    assert call("x", source, "--to", out) == (DONE, "written\t2\n")
    assert (out / "a" / "one.txt").read_text() == "first\n" and sorted(os.listdir(out)) == ["a", "b"]
    assert call("x", source, "--to", out) == (DONE, "exists\t2\n")
    assert call("e", source, "--to", tmp_path / "flat")[0] == DONE and sorted(os.listdir(tmp_path / "flat")) == ["one.txt", "two.txt"]
    at = data.index(b"second") + 2000
    (source / "x.rar").write_bytes(data[:at] + b"\0" + data[at + 1 :])
    assert call("t", source)[0] == CHECKSUM and call("errors", source)[0] == CHECKSUM
    assert call("repair", source, "--to", tmp_path / "fixed") == (DONE, "written\t1\n")
    assert (tmp_path / "fixed" / "x.rar").read_bytes() == data
