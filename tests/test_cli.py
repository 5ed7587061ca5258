from quillmark.__main__ import main, preflight
from quillmark.config import Settings


def test_documents_are_shown_and_searched(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr("sys.argv", ["quillmark"])
    (tmp_path / "a.md").write_text("# Title\n\nSome words to be found here.\n")
    assert main(["document", str(tmp_path / "a.md")]) == 0
    assert "Some words" in capsys.readouterr().out
    assert main(["locate", str(tmp_path / "a.md"), "WORDS to be found"]) == 0
    assert "exact" in capsys.readouterr().out


def test_preflight(capsys, monkeypatch):
    for name in ("S3_BUCKET", "AWS_REGION", "KAFKA_BOOTSTRAP_SERVERS"):
        monkeypatch.delenv(name, raising=False)
    assert main(["check"]) == 1 and "S3_BUCKET is not set" in capsys.readouterr().out
    env = {"S3_BUCKET": "b", "AWS_REGION": "r", "KAFKA_BOOTSTRAP_SERVERS": "k:1", "LOCAL_ROOTS": "/no/such/folder"}
    assert preflight(Settings.from_env(env)) == {"storage": "ok", "local_roots": "/no/such/folder is no folder", "queue": "ok"}
