from deckflow import session


def test_discarded_tables_are_gone(spark, monkeypatch):
    monkeypatch.setattr(session, "_MADE", [])
    stored = session.materialize(spark.range(5), "five")
    assert stored.count() == 5
    (folder,) = session._MADE
    never = session.scratch_path(spark, "unused")
    session.discard_scratch()
    fs, path = session.pafs.FileSystem.from_uri("/" + folder.removeprefix("file:").lstrip("/"))
    assert fs.get_file_info(path).type == session.pafs.FileType.NotFound
    assert session._MADE == [] and never


def test_names_of_stores(monkeypatch):
    import pyarrow.fs as pafs

    from deckflow import session

    asked = []

    class Stores:
        @staticmethod
        def from_uri(uri):
            asked.append(uri)
            return pafs.LocalFileSystem(), uri.split("://")[1]

    monkeypatch.setattr(session.pafs, "FileSystem", Stores)
    for uri in ("s3a://bucket/x", "s3://bucket/x", "gs://bucket/x"):
        assert session.file_store(uri)[1] == "bucket/x"
    assert asked == ["s3://bucket/x", "s3://bucket/x", "gs://bucket/x"]
    assert [session.file_store(u)[1] for u in ("dbfs:/a/b", "file:/a/b", "file:///a/b", "/a/b")] == ["/dbfs/a/b", "/a/b", "/a/b", "/a/b"]
