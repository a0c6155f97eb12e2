"""Services and models behind small interfaces.

A backend is built once per Python worker and asked in batches; its failures become
rows with an error, never a failed job. Answers are meant to be written as a table
before they are joined, so that a retried task doesn't ask again.
"""

from __future__ import annotations

import base64
import io
import json
import random
import urllib.request
import uuid
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame


class TextModel(Protocol):
    """Answers a prompt, with a picture where there is one."""

    def answer(self, prompt: str, image: bytes | None = None) -> str: ...


class Recogniser(Protocol):
    """Reads the text of an image: (text, confidence, (x, y, w, h)) in reading order."""

    def tokens(self, image: bytes) -> list[tuple[str, float, tuple[int, int, int, int]]]: ...


class NothingRecognised:
    """The recogniser that is left when none is installed."""

    def tokens(self, image: bytes) -> list:
        return []


def _post(url: str, body: bytes, kind: str, seconds: float) -> bytes:
    request = urllib.request.Request(url, data=body, headers={"Content-Type": kind})
    with urllib.request.urlopen(request, timeout=seconds) as reply:
        return reply.read()


class GenerateEndpoint:
    """A model served at ``/api/generate``."""

    def __init__(self, url: str, model: str, seconds: float = 120.0):
        self.url, self.model, self.seconds = url.rstrip("/"), model, seconds

    def answer(self, prompt: str, image: bytes | None = None) -> str:
        body = {"model": self.model, "prompt": prompt, "stream": False}
        if image is not None:
            body["images"] = [base64.b64encode(image).decode()]
        return json.loads(_post(f"{self.url}/api/generate", json.dumps(body).encode(), "application/json", self.seconds))["response"]


class ChatEndpoint:
    """A model served at ``/v1/chat/completions``, else at ``/completion``."""

    def __init__(self, url: str, seconds: float = 120.0):
        self.url, self.seconds = url.rstrip("/"), seconds

    def answer(self, prompt: str, image: bytes | None = None) -> str:
        shown = None if image is None else base64.b64encode(image).decode()
        said = prompt if shown is None else [{"type": "text", "text": prompt}, {"type": "image_url", "image_url": {"url": f"data:image/png;base64,{shown}"}}]
        try:
            body = {"messages": [{"role": "user", "content": said}], "stream": False}
            reply = json.loads(_post(f"{self.url}/v1/chat/completions", json.dumps(body).encode(), "application/json", self.seconds))
            return reply["choices"][0]["message"]["content"]
        except (OSError, ValueError, KeyError, IndexError):
            plain = {"prompt": prompt} if shown is None else {"prompt": f"[img-1]\n{prompt}", "image_data": [{"data": shown, "id": 1}]}
            reply = json.loads(_post(f"{self.url}/completion", json.dumps(plain).encode(), "application/json", self.seconds))
            return reply["content"]


class LocalModel:
    """A model run in the worker by the transformers library, which has to be installed there."""

    def __init__(self, model: str, most: int = 512):
        from transformers import pipeline

        self.run, self.most = pipeline("image-text-to-text", model=model), most

    def answer(self, prompt: str, image: bytes | None = None) -> str:
        content = [{"type": "text", "text": prompt}]
        if image is not None:
            from PIL import Image

            content.insert(0, {"type": "image", "image": Image.open(io.BytesIO(image))})
        said = self.run(text=[{"role": "user", "content": content}], max_new_tokens=self.most, return_full_text=False)[0]["generated_text"]
        return said if isinstance(said, str) else said[-1]["content"]


#: What makes a model, by the name of its kind.
MODELS: dict[str, Callable[..., TextModel]] = {"generate": GenerateEndpoint, "chat": ChatEndpoint, "local": LocalModel}


def text_model(kind: str, **options) -> Callable[[], TextModel]:
    """What builds a model of a kind of ``MODELS`` in each worker; a kind that isn't known is an error here, not there."""
    if kind not in MODELS:
        raise ValueError(f"{kind}: no kind of model; there are {', '.join(sorted(MODELS))}")
    return lambda: MODELS[kind](**options)


def seeded(model: Callable[[], TextModel], seed: int = 42) -> Callable[[], TextModel]:
    """``model`` with the worker's random numbers starting at ``seed``, those of torch too where it is installed."""

    def build() -> TextModel:
        import numpy as np

        random.seed(seed)
        np.random.seed(seed)
        try:
            import torch

            torch.manual_seed(seed)
        except ImportError:
            pass
        return model()

    return build


class TesseractRecogniser:
    """Words by pytesseract, which has to be installed on the executors."""

    def __init__(self, languages: str = "eng"):
        import pytesseract
        from PIL import Image

        self.read, self.open, self.languages = pytesseract.image_to_data, Image.open, languages

    def tokens(self, image: bytes) -> list[tuple[str, float, tuple[int, int, int, int]]]:
        found = self.read(self.open(io.BytesIO(image)), lang=self.languages, output_type="dict")
        boxes = zip(found["left"], found["top"], found["width"], found["height"])
        return [(t.strip(), float(c) / 100, b) for t, c, b in zip(found["text"], found["conf"], boxes) if t.strip() and float(c) >= 0]


class PaddleRecogniser:
    """Lines by paddleocr, which has to be installed on the executors."""

    def __init__(self, language: str = "en"):
        from paddleocr import PaddleOCR

        self.engine = PaddleOCR(lang=language)

    def tokens(self, image: bytes) -> list[tuple[str, float, tuple[int, int, int, int]]]:
        import numpy as np
        from PIL import Image

        out = []
        for page in self.engine.ocr(np.asarray(Image.open(io.BytesIO(image)).convert("RGB"))) or []:
            for corners, (text, confidence) in page or []:
                xs, ys = [int(x) for x, _ in corners], [int(y) for _, y in corners]
                if text.strip():
                    out.append((text.strip(), float(confidence), (min(xs), min(ys), max(xs) - min(xs), max(ys) - min(ys))))
        return out


def best_recogniser() -> Recogniser:
    """The first recogniser that is installed, else one that reads nothing."""
    for kind in (PaddleRecogniser, TesseractRecogniser):
        try:
            return kind()
        except ImportError:
            continue
    return NothingRecognised()


class FulltextService:
    """Turns a PDF into structured full text over HTTP."""

    def __init__(self, url: str, seconds: float = 300.0):
        self.url, self.seconds = url.rstrip("/"), seconds

    def parse(self, pdf: bytes) -> str:
        mark = uuid.uuid4().hex
        body = b"".join([f'--{mark}\r\nContent-Disposition: form-data; name="input"; filename="a.pdf"\r\nContent-Type: application/pdf\r\n\r\n'.encode(), pdf, f"\r\n--{mark}--\r\n".encode()])
        return _post(f"{self.url}/api/processFulltextDocument", body, f"multipart/form-data; boundary={mark}", self.seconds).decode("utf-8")


def parse_papers(pdfs: DataFrame, service: Callable[[], FulltextService]) -> DataFrame:
    """(paper_id, path, tei_xml, success, error) of PDF files; what fails says why."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parser = service()
        for batch in batches:
            rows = []
            for paper, path, content in batch[["paper_id", "path", "content"]].itertuples(index=False):
                try:
                    rows.append((paper, path, parser.parse(bytes(content)), True, None))
                except Exception as e:
                    rows.append((paper, path, None, False, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["paper_id", "path", "tei_xml", "success", "error"])

    return pdfs.select("paper_id", "path", "content").mapInPandas(run, "paper_id string, path string, tei_xml string, success boolean, error string")


def ask(rows: DataFrame, key: str, prompt: str, model: Callable[[], TextModel]) -> DataFrame:
    """(key, answer, error): a model's answers to the prompts of ``rows``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        backend = model()
        for batch in batches:
            out = []
            for k, p in batch[["_k", "_p"]].itertuples(index=False):
                try:
                    out.append((k, backend.answer(p), None))
                except Exception as e:
                    out.append((k, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["_k", "answer", "error"])

    asked = rows.select(rows[key].alias("_k"), rows[prompt].alias("_p")).where("_p is not null")
    kind = asked.schema["_k"].dataType.simpleString()
    return asked.mapInPandas(run, f"_k {kind}, answer string, error string").withColumnRenamed("_k", key)


def render_pages(pdfs: DataFrame, dpi: int = 200) -> DataFrame:
    """(paper_id, page_index, png, text, width, height, error) of PDF files; pages from 1.

    Needs PyMuPDF on the executors; without it every file gives one row with the error.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["paper_id", "page_index", "png", "text", "width", "height", "error"]
        for batch in batches:
            rows = []
            for paper, content in batch[["paper_id", "content"]].itertuples(index=False):
                try:
                    import fitz

                    with fitz.open(stream=bytes(content), filetype="pdf") as doc:
                        for k, page in enumerate(doc, 1):
                            shot = page.get_pixmap(dpi=dpi)
                            rows.append((paper, k, shot.tobytes("png"), page.get_text(), shot.width, shot.height, None))
                except Exception as e:
                    rows.append((paper, None, None, None, None, None, f"{type(e).__name__}: {e}"))
            frame = pd.DataFrame(rows, columns=columns)
            yield frame.astype({"page_index": "Int32", "width": "Int32", "height": "Int32"})

    return pdfs.select("paper_id", "content").mapInPandas(run, "paper_id string, page_index int, png binary, text string, width int, height int, error string")


def recognise(images: DataFrame, key: str, recogniser: Callable[[], Recogniser]) -> DataFrame:
    """(key, pos, text, confidence, bbox): the tokens of images (key, png)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = recogniser()
        for batch in batches:
            rows = []
            for k, image in batch[["_k", "png"]].itertuples(index=False):
                for pos, (text, confidence, (x, y, w, h)) in enumerate(reader.tokens(bytes(image))):
                    rows.append((k, pos, text, confidence, {"x": x, "y": y, "w": w, "h": h}))
            yield pd.DataFrame(rows, columns=["_k", "pos", "text", "confidence", "bbox"])

    rows = images.select(images[key].alias("_k"), "png")
    kind = rows.schema["_k"].dataType.simpleString()
    return rows.mapInPandas(run, f"_k {kind}, pos int, text string, confidence double, bbox struct<x:int,y:int,w:int,h:int>").withColumnRenamed("_k", key)
