import json

import pytest

from noemata.__main__ import main


def test_init_ingest_search(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr("noemata.__main__._session", lambda: spark)
    (tmp_path / "v.json").write_text(json.dumps({"language": "code", "anchors": {"save": {"type": "actor", "tokens": ["save"]}}}))
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "store.py").write_text("import os\n\n\ndef save(row):\n    return connect(row)\n")
    with pytest.raises(SystemExit):
        main(["stats", str(tmp_path / "none")])
    main(["init", str(tmp_path / "kb"), str(tmp_path / "v.json")])
    main(["ingest", str(tmp_path / "kb"), str(tmp_path / "src")])
    main(["search", str(tmp_path / "kb"), "what does save call"])
    main(["stats", str(tmp_path / "kb")])
    out = capsys.readouterr().out
    assert "connect" in out and "store" in out
