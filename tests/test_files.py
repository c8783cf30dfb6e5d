"""The corpus data source: names, whole files, byte ranges, and numbering of records over ranges."""
import json
import tempfile
from pathlib import Path

import pytest

from talkweave.sources import corpus as C
from talkweave.sources.files import read_files


@pytest.fixture
def folder():
    d = Path(tempfile.mkdtemp(prefix="run-"))
    (d / "deep" / ".kept").mkdir(parents=True)
    for name, text in [("_notes.md", "under"), ("a.MD", "a\nb"), (".hidden.md", "no"), ("README.md", "no"), ("c.txt", ""), ("d.pdf", "no"),
                       ("deep/e.markdown", "é\r\nf"), ("deep/.kept/g.md", "in a dot folder"), ("h.txt.bak", "no")]:
        (d / name).write_bytes(text.encode())
    return d


def test_files_are_chosen_by_name_and_suffix(spark, folder):
    got = {str(Path(r["path"]).relative_to(folder)): r["raw"] for r in read_files(spark, str(folder), "md", "markdown", "txt", whole=True).collect()}
    assert got == {"_notes.md": "under", "a.MD": "a\nb", "c.txt": "", "deep/e.markdown": "é\r\nf", "deep/.kept/g.md": "in a dot folder"}
    for path in (folder.as_uri(), f"file:{folder}"):
        assert read_files(spark, path, "md", whole=True).count() == 3
    assert read_files(spark, str(folder), "none").count() == 0
    with pytest.raises(Exception, match="nowhere"):
        read_files(spark, str(folder / "nowhere"), "md").count()


@pytest.mark.parametrize("size", [3, 7, 64, 1 << 20])
def test_every_line_is_read_once_at_its_offset(spark, folder, size):
    raw = b"one\n\ntwo\r\n" + "drei é\n".encode() + b"\xff bad\n" + b"x" * 50 + b"\n\n\nlast"
    (folder / "lines.jsonl").write_bytes(raw)
    (folder / "empty.jsonl").write_bytes(b"")
    want, at = [], 0
    for line in raw.split(b"\n"):
        want.append((at, line.removesuffix(b"\r").decode("utf-8", "replace")))
        at += len(line) + 1
    df = read_files(spark, str(folder), "jsonl", range_bytes=size)
    assert sorted((r["offset"], r["raw"]) for r in df.collect()) == want
    assert df.rdd.getNumPartitions() == -(-len(raw) // size)


def test_records_are_numbered_by_offset_over_ranges_and_stretches(spark, folder):
    rows = [{"doc_id": "A" if i % 3 else "B", "text": f"t{i}"} for i in range(200)] + [{"id": "A", "section": "own", "text": "s"}, {"doc_id": "A", "text": "end"}]
    (folder / "r.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n\n")
    seen, want = {}, set()
    for r in rows:
        doc = r.get("doc_id") or r["id"]
        seen[doc] = seen.get(doc, 0) + 1
        want.add((f"{doc}§{r.get('section') or seen[doc]}", r["text"]))
    got = C.jsonl_chunks(read_files(spark, str(folder), "jsonl", range_bytes=100), block=300)
    assert {(r["chunk_id"], r["text"]) for r in got.select("chunk_id", "text").collect()} == want
