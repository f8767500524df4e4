"""Markdown parts do not follow the size of a partition."""

from folio.sources.folders import MarkdownReader, MarkdownWriter


def test_a_partition_is_written_in_parts(tmp_path, monkeypatch):
    monkeypatch.setattr(MarkdownWriter, "PART_BYTES", 300)
    root = str(tmp_path / "out")
    writer = MarkdownWriter(root, True)
    rows = [{"title": f"t{i}", "content": "é" * 40} for i in range(20)]
    writer.commit([writer.write(iter(rows)), writer.write(iter([])), None])
    reader = MarkdownReader(root)
    back = [r for p in reader.partitions() for r in reader.read(p)]
    assert len(back) == 5 and all(size < 300 + 100 for _, _, size in back)
    whole = "".join(text for _, text, _ in sorted(back))
    assert whole == "".join(f"## t{i}\n\n{'é' * 40}\n\n---\n" for i in range(20))
    assert sorted(x.name for x in (tmp_path / "out").iterdir() if x.name.startswith(".")) == []
