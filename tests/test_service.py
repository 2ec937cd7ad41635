"""The jobs' HTTP interface."""

import io
import json
import subprocess
import threading
import time
import urllib.request

import pytest

from millrace.plans.service import PAGE, Service, serve


def asked(app, method, path, said=None, kind="application/json"):
    body, got = b"" if said is None else said if isinstance(said, bytes) else json.dumps(said).encode(), {}
    environ = {"REQUEST_METHOD": method, "PATH_INFO": path, "CONTENT_TYPE": kind, "CONTENT_LENGTH": str(len(body)), "wsgi.input": io.BytesIO(body)}
    out = b"".join(app(environ, lambda status, headers: got.update(status=int(status[:3]), headers=dict(headers))))
    return got["status"], json.loads(out) if "json;" in got["headers"]["Content-Type"] else out.decode()


@pytest.fixture
def origin(tmp_path):
    at = tmp_path / "origin"
    at.mkdir()
    (at / "a.md").write_text("# Notes\n" + "word " * 200)
    for command in (["init", "-q"], ["add", "-A"], ["-c", "user.name=a", "-c", "user.email=a@b", "commit", "-q", "-m", "x"]):
        subprocess.run(["git", "-C", str(at), *command], check=True)
    return f"file://{at}"


def ended(app, job):
    end = time.time() + 180
    while time.time() < end and asked(app, "GET", f"/api/jobs/{job}")[1]["state"] in ("queued", "running"):
        time.sleep(0.3)
    return asked(app, "GET", f"/api/jobs/{job}")[1]


def test_a_job_from_start_to_download(spark, origin, tmp_path):
    opened = []
    app = Service(spark, str(tmp_path / "out"), sources=("file://",), opener=opened.append)
    status, begun = asked(app, "POST", "/api/jobs", {"repo_url": origin, "output_name": "mine", "options": {"min_tokens": 1, "md_max_questions_per_section": 2}})
    assert status == 200 and begun["output_dir"] == str(tmp_path / "out" / "mine")
    job = ended(app, begun["job_id"])
    assert job["state"] == "done" and job["progress"] == 100 and job["logs"] and job["error_message"] is None
    at = f"/api/jobs/{begun['job_id']}"
    result = asked(app, "GET", f"{at}/result")[1]
    assert result["counts"]["total"] > 0 and len(result["sha"]) == 40 and set(result["files"]) == {"train", "valid", "stats"}
    taken = [asked(app, "GET", f"{at}/download/{name}")[1] for name in ("train", "valid")]
    assert [len(t.splitlines()) for t in taken] == [result["counts"]["train"], result["counts"]["valid"]] and all(json.loads(x)["messages"] for t in taken for x in t.splitlines())
    assert json.loads(asked(app, "GET", f"{at}/download/stats")[1]) == result["counts"]
    assert asked(app, "GET", f"{at}/download/other")[0] == 400
    listing = asked(app, "GET", f"/jobs/{begun['job_id']}/output/")[1]
    assert listing.index("dataset.train.jsonl") < listing.index("dataset.valid.jsonl") < listing.index("stats.json") and f"{at}/download/stats" in listing
    assert asked(app, "POST", f"{at}/open-output") == (200, {"ok": True, "output_dir": begun["output_dir"]}) and opened == [begun["output_dir"]]
    assert [x["job_id"] for x in asked(app, "GET", "/api/jobs")[1]] == [begun["job_id"]]


def test_what_is_refused(spark, tmp_path):
    def broken(folder):
        raise OSError("no screen")

    app = Service(spark, str(tmp_path), sources=("file://",), opener=broken)
    good = "file:///missing"
    for said in (None, [], {}, b"{", {"output_name": "x"}, {"repo_url": "--upload-pack=x"}, {"repo_url": "https://a/b"}, {"repo_url": good, "output_name": "../x"}, {"repo_url": good, "output_name": "/etc"},
                 {"repo_url": good, "options": {"unknown": 1}}, {"repo_url": good, "options": [1]}, {"repo_url": good, "output_name": 3}):
        status, got = asked(app, "POST", "/api/jobs", said)
        assert status == 400 and got["error"], said
    assert asked(app, "POST", "/api/jobs", {"repo_url": good}, "text/plain")[0] == 415
    assert asked(app, "POST", "/api/jobs", b" " * ((1 << 20) + 1))[0] == 413
    assert asked(app, "GET", "/api/jobs/abc")[0] == asked(app, "GET", "/api/jobs/abc/result")[0] == asked(app, "GET", "/nothing")[0] == 404
    assert asked(app, "DELETE", "/api/jobs/abc")[0] == 405
    assert asked(app, "GET", "/api/jobs")[1] == []
    begun = asked(app, "POST", "/api/jobs", {"repo_url": good})[1]
    assert begun["output_dir"].startswith(str(tmp_path / "missing_"))
    assert ended(app, begun["job_id"])["state"] == "error" and asked(app, "GET", f"/api/jobs/{begun['job_id']}/download/train")[0] == 400
    job = app.jobs.get(begun["job_id"])
    job.state, job.result = "done", {"output_dir": "/etc"}
    assert {asked(app, "GET", f"/jobs/{job.job_id}/output/")[0], asked(app, "GET", f"/api/jobs/{job.job_id}/download/train")[0]} == {403}
    job.result = {"output_dir": str(tmp_path)}
    status, got = asked(app, "POST", f"/api/jobs/{job.job_id}/open-output")
    assert status == 500 and got["copy_fallback"] and got["output_dir"] == str(tmp_path)
    assert asked(app, "GET", f"/api/jobs/{job.job_id}/download/stats")[0] == 404


def test_the_server_answers(spark, tmp_path):
    server = serve(Service(spark, str(tmp_path)), port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        page = urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}/", timeout=20).read().decode()
    finally:
        server.shutdown()
        server.server_close()
    assert 'name="min_tokens" value="48"' in page and 'name="py_chunking" checked' in page and PAGE.split("%s")[0] in page and "%%" not in page
