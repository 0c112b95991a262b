import datetime
import hashlib
import http.server
import threading

import pytest

from tidewater.operators.select import select


def test_templates(spark):
    df = spark.createDataFrame([("ab", datetime.datetime(2024, 5, 17, 10), 7, None)], "s string, t timestamp, n int, z string")
    calls = {
        "${s}-${z}-${n}": "ab--7", "${utils.string.format('%05d/%s', n, s)}": "00007/ab", "${utils.string.replaceAll(s, '[a]', 'x,y')}!": "x,yb!", "${utils.string.reverse(s)}": "ba",
        "${utils.string.md5(s)}": hashlib.md5(b"ab").hexdigest(), "${utils.string.base64(s)}": "YWI=", "${utils.datetime.formatTimestamp(t, 'yyyy/MM/dd HH', 'Asia/Tokyo')}": "2024/05/17 19", "${utils.datetime.formatDate(t, 'yyyyMMdd')}": "20240517",
    }
    assert list(select(df, [{"name": f"c{i}", "text": t} for i, t in enumerate(calls)]).first()) == list(calls.values())
    with pytest.raises(ValueError):
        select(df, [{"name": "x", "text": "${utils.string.nothing(s)}"}])


def test_tokenize(spark, tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    path = str(tmp_path / "words.json")
    words = tokenizers.Tokenizer(tokenizers.models.WordLevel({"<unk>": 0, "a": 1, "b": 2}, unk_token="<unk>"))
    words.pre_tokenizer = tokenizers.pre_tokenizers.Whitespace()
    words.save(path)
    df = spark.createDataFrame([("a b c",), ("",), (None,)], "s string")
    out = select(df, [{"name": "ids", "func": "tokenize_encode", "field": "s", "tokenizer": path}, {"name": "back", "func": "tokenize_decode", "field": "ids", "tokenizer": path}])
    assert [tuple(r) for r in out.collect()] == [([1, 2, 0], "a b <unk>"), ([], ""), (None, None)]


def test_http(spark):
    asked = []

    class Answer(http.server.BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            body = self.rfile.read(int(self.headers["Content-Length"])).decode()
            asked.append(self.path)
            code = 404 if self.path == "/gone" else 503 if asked.count(self.path) == 1 else 200
            self.send_response(code)
            self.end_headers()
            self.wfile.write(('{"got": "' + body + '"}').encode())

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        df = spark.createDataFrame([("p", "x"), ("p", "x"), ("gone", "y")], "s string, b string").coalesce(1)
        out = select(df, [{"name": "a", "func": "http", "url": f"http://127.0.0.1:{server.server_port}/${{s}}", "body": "${b}", "path": "$.got"}]).collect()
        assert [r.a for r in out] == ["x", "x", None] and asked.count("/gone") == 1 and asked.count("/p") == 2
    finally:
        server.shutdown()
