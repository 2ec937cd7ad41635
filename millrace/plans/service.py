"""Jobs over HTTP: start one, ask after it, take what it has written."""

from __future__ import annotations

import argparse
import html
import json
import re
import subprocess
import sys
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import asdict
from http import HTTPStatus
from pathlib import Path, PurePosixPath
from socketserver import ThreadingMixIn
from urllib.parse import unquote
from wsgiref.simple_server import WSGIServer, make_server

from pyspark.sql import SparkSession

from ..config import ChatConfig, environment
from .chat import Progress, generate_from_url
from .jobs import Job, Jobs, is_inside

#: What can be taken from a job, and where it lies in its folder.
FILES = {"train": "dataset.train.jsonl", "valid": "dataset.valid.jsonl", "stats": "stats.json"}
#: Options that go by another name in requests.
ALIASES = {"md_max_questions_per_section": "md_max_questions"}
MOST_BYTES = 1 << 20

PAGE = """<!doctype html><meta charset="utf-8"><title>Chat records</title>
<form id="f"><input name="repo_url" size="60" placeholder="https://" required> <input name="output_name" placeholder="name of the output"><br>
%s<br><button>Start</button></form><pre id="said"></pre><p id="links"></p>
<script>
const f = document.getElementById("f"), said = document.getElementById("said"), links = document.getElementById("links");
f.onsubmit = async e => {
  e.preventDefault();
  const options = {};
  for (const x of f.querySelectorAll("[data-option]")) options[x.name] = x.type == "checkbox" ? x.checked : parseInt(x.value) || parseInt(x.defaultValue);
  const body = {repo_url: f.repo_url.value.trim(), output_name: f.output_name.value.trim() || null, options};
  const begun = await (await fetch("/api/jobs", {method: "POST", headers: {"Content-Type": "application/json"}, body: JSON.stringify(body)})).json();
  if (begun.error) { said.textContent = begun.error; return; }
  const timer = setInterval(async () => {
    const job = await (await fetch("/api/jobs/" + begun.job_id)).json();
    said.textContent = `${job.state} ${job.progress} %%\\n${job.logs.join("\\n")}\\n${job.error_message || ""}`;
    if (job.state == "done" || job.state == "error") clearInterval(timer);
    if (job.state == "done") links.innerHTML = `<a href="/jobs/${begun.job_id}/output/">what it has written</a>`;
  }, 1000);
};
</script>"""


class Refused(Exception):
    """An answer that isn't what was asked for."""

    def __init__(self, status: HTTPStatus, said: str, **more: object):
        super().__init__(said)
        self.status, self.body = status, {"error": said, **more}


def open_folder(folder: str) -> None:
    """Show a folder in the file manager of the machine that runs the service."""
    subprocess.Popen([{"darwin": "open", "win32": "explorer"}.get(sys.platform, "xdg-open"), folder])


def _parts(path: Path) -> Iterator[bytes]:
    """A file, or the part files of a written folder one after another."""
    for part in sorted(path.glob("part-*")) if path.is_dir() else [path]:
        with part.open("rb") as f:
            while block := f.read(1 << 16):
                yield block


def _option(name: str, value: object) -> str:
    if isinstance(value, bool):
        return f'<label><input type="checkbox" data-option name="{name}"{" checked" if value else ""}> {name}</label>'
    return f'<label>{name} <input type="number" data-option name="{name}" value="{value}"></label>'


Answer = tuple[HTTPStatus, list[tuple[str, str]], Iterable[bytes]]


class Service:
    """A WSGI application over the jobs of one session.

    sources: how addresses to clone have to begin; shared: where all executors see clones, which a cluster needs.
    Outputs lie below out_root, a folder that this machine sees.
    """

    def __init__(self, spark: SparkSession, out_root: str, shared: str | None = None, sources: tuple[str, ...] = ("https://",), opener: Callable[[str], None] = open_folder):
        self.jobs, self.out_root, self.shared, self.sources, self.opener = Jobs(spark, out_root), Path(out_root), shared, sources, opener
        job = r"([0-9a-f]+)"
        self._routes = [
            ("GET", "/", self.index), ("POST", "/api/jobs", self.create), ("GET", "/api/jobs", self.all), ("GET", f"/api/jobs/{job}", self.status), ("GET", f"/api/jobs/{job}/result", self.result),
            ("GET", f"/api/jobs/{job}/download/([^/]+)", self.download), ("POST", f"/api/jobs/{job}/open-output", self.open_output), ("GET", f"/jobs/{job}/output/", self.browse),
        ]

    def __call__(self, environ: dict, start_response: Callable) -> Iterable[bytes]:
        try:
            status, headers, body = self._answer(environ)
        except Refused as e:
            status, headers, body = self._json(e.body, e.status)
        start_response(f"{status.value} {status.phrase}", headers)
        return body

    def _answer(self, environ: dict) -> Answer:
        path, other = unquote(environ.get("PATH_INFO") or "/"), False
        for method, pattern, handler in self._routes:
            if m := re.fullmatch(pattern, path):
                if method == environ["REQUEST_METHOD"]:
                    return handler(environ) if handler == self.create else handler(*m.groups())
                other = True
        raise Refused(HTTPStatus.METHOD_NOT_ALLOWED, "not that way") if other else Refused(HTTPStatus.NOT_FOUND, "there is nothing here")

    def _json(self, value: object, status: HTTPStatus = HTTPStatus.OK) -> Answer:
        return status, [("Content-Type", "application/json; charset=utf-8")], [json.dumps(value, ensure_ascii=False).encode()]

    def _html(self, said: str) -> Answer:
        return HTTPStatus.OK, [("Content-Type", "text/html; charset=utf-8")], [said.encode()]

    def _job(self, job_id: str) -> Job:
        job = self.jobs.get(job_id)
        if job is None:
            raise Refused(HTTPStatus.NOT_FOUND, "no such job")
        return job

    def _done(self, job_id: str) -> dict:
        if self._job(job_id).state != "done":
            raise Refused(HTTPStatus.BAD_REQUEST, "the job isn't done")
        return self.jobs.result(job_id)

    def _folder(self, job_id: str) -> Path:
        folder = self._done(job_id)["output_dir"]
        if not is_inside(folder, str(self.out_root)):
            raise Refused(HTTPStatus.FORBIDDEN, "not below the outputs")
        return Path(folder)

    def _said(self, environ: dict) -> dict:
        """The request's JSON object."""
        if environ.get("CONTENT_TYPE", "").split(";")[0].strip() != "application/json":
            raise Refused(HTTPStatus.UNSUPPORTED_MEDIA_TYPE, "JSON is asked for")
        try:
            size = int(environ.get("CONTENT_LENGTH") or 0)
            if size > MOST_BYTES:
                raise Refused(HTTPStatus.REQUEST_ENTITY_TOO_LARGE, "that is too long")
            said = json.loads(environ["wsgi.input"].read(size) or b"null")
        except ValueError as e:
            raise Refused(HTTPStatus.BAD_REQUEST, f"not JSON: {e}") from e
        if not isinstance(said, dict) or not said:
            raise Refused(HTTPStatus.BAD_REQUEST, "a JSON object is asked for")
        return said

    def _plan(self, spark: SparkSession, url: str, out: str, config: ChatConfig, progress: Progress | None = None) -> dict:
        made = generate_from_url(spark, url, out, config, self.shared, progress)
        return made | {"output_dir": out, "files": {name: f"{out}/{file}" for name, file in FILES.items()}}

    def index(self) -> Answer:
        return self._html(PAGE % " ".join(_option(name, value) for name, value in asdict(ChatConfig()).items() if not isinstance(value, float)))

    def create(self, environ: dict) -> Answer:
        said = self._said(environ)
        url, name, options = said.get("repo_url"), said.get("output_name"), said.get("options") or {}
        if not isinstance(url, str) or not url.startswith(self.sources):
            raise Refused(HTTPStatus.BAD_REQUEST, f"repo_url has to begin with {' or '.join(self.sources)}")
        if not isinstance(options, dict) or not isinstance(name or "", str):
            raise Refused(HTTPStatus.BAD_REQUEST, "options are an object, output_name is a text")
        name = name or f"{PurePosixPath(url.rstrip('/')).name.removesuffix('.git')}_{time.strftime('%Y%m%d_%H%M%S')}"
        out = str(self.out_root.resolve() / name)
        try:
            job_id = self.jobs.create(url, out, {ALIASES.get(k, k): v for k, v in options.items()}, self._plan)
        except (TypeError, ValueError) as e:  # an option or a folder that there isn't
            raise Refused(HTTPStatus.BAD_REQUEST, str(e)) from e
        return self._json({"job_id": job_id, "output_dir": out})

    def all(self) -> Answer:
        return self._json([asdict(job) for job in self.jobs.list()])

    def status(self, job_id: str) -> Answer:
        return self._json(asdict(self._job(job_id)))

    def result(self, job_id: str) -> Answer:
        return self._json(self._done(job_id))

    def download(self, job_id: str, name: str) -> Answer:
        folder = self._folder(job_id)
        if name not in FILES:
            raise Refused(HTTPStatus.BAD_REQUEST, f"one of {', '.join(FILES)} is asked for")
        path = folder / FILES[name]
        if not is_inside(str(path), str(self.out_root)):
            raise Refused(HTTPStatus.FORBIDDEN, "not below the outputs")
        if not path.exists():
            raise Refused(HTTPStatus.NOT_FOUND, "the file is gone")
        return HTTPStatus.OK, [("Content-Type", "application/json"), ("Content-Disposition", f'attachment; filename="{FILES[name]}"')], _parts(path)

    def open_output(self, job_id: str) -> Answer:
        folder = self._folder(job_id)
        if not folder.exists():
            raise Refused(HTTPStatus.NOT_FOUND, "the folder is gone", output_dir=str(folder))
        try:
            self.opener(str(folder))
        except Exception as e:  # whatever the machine's file manager has against it
            raise Refused(HTTPStatus.INTERNAL_SERVER_ERROR, f"can't be opened: {e}", output_dir=str(folder), copy_fallback=True) from e
        return self._json({"ok": True, "output_dir": str(folder)})

    def browse(self, job_id: str) -> Answer:
        folder = self._folder(job_id)
        links = {file: f"/api/jobs/{job_id}/download/{name}" for name, file in FILES.items()}
        there = sorted(p.name for p in folder.iterdir() if not p.name.startswith(".")) if folder.exists() else []
        listed = (f'<a href="{links[n]}">{html.escape(n)}</a>' if n in links else html.escape(n) for n in there)
        return self._html(f'<!doctype html><meta charset="utf-8"><title>Output</title><h1>{html.escape(str(folder))}</h1><ul>{"".join(f"<li>{x}</li>" for x in listed)}</ul>')


class _Server(ThreadingMixIn, WSGIServer):
    daemon_threads = True


def serve(service: Service, host: str = "127.0.0.1", port: int = 5001) -> WSGIServer:
    """A server that is bound; its serve_forever() answers. Who may reach it may start jobs, so it listens to this machine alone unless told otherwise."""
    return make_server(host, port, service, server_class=_Server)


def main(args: list[str] | None = None) -> None:
    env = environment()
    p = argparse.ArgumentParser(description="Chat records of source trees, over HTTP")
    p.add_argument("--host", default="127.0.0.1")
    p.add_argument("--port", type=int, default=5001)
    p.add_argument("--output-root", default=env.get("MILLRACE_OUTPUT_ROOT", "./outputs"))
    p.add_argument("--shared", default=env.get("MILLRACE_SHARED"), help="where all executors see clones; a cluster needs it")
    said = p.parse_args(args)
    Path(said.output_root).mkdir(parents=True, exist_ok=True)
    server = serve(Service(SparkSession.builder.getOrCreate(), said.output_root, said.shared), said.host, said.port)
    print(f"http://{said.host}:{server.server_port}")
    server.serve_forever()


if __name__ == "__main__":
    main()
