"""A small PDF writer: A4 pages of text, boxes and JPEG images. Lengths are millimetres from the upper left corner."""

from __future__ import annotations

from typing import BinaryIO

PAGE_W, PAGE_H, MARGIN = 210.0, 297.0, 15.0
_PT = 72 / 25.4


class Page:
    def __init__(self):
        self.ops: list[bytes] = []
        self.images: dict[str, int] = {}

    def text(self, x: float, y: float, size: float, text: str) -> None:
        """Characters beyond Latin-1 become question marks."""
        said = text.encode("latin-1", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)").replace(b"\n", b" ").replace(b"\r", b" ")
        self.ops.append(f"BT /F {size:.1f} Tf {x * _PT:.2f} {(PAGE_H - y) * _PT:.2f} Td (".encode() + said + b") Tj ET")

    def box(self, x: float, y: float, w: float, h: float, gray: float | None = None) -> None:
        """An outline or, with gray (0 black, 1 white), a filled box."""
        place = f"{x * _PT:.2f} {(PAGE_H - y - h) * _PT:.2f} {w * _PT:.2f} {h * _PT:.2f} re"
        self.ops.append((f"{place} S" if gray is None else f"{gray:.2f} g {place} f 0 g").encode())

    def image(self, number: int, x: float, y: float, w: float, h: float) -> None:
        self.images[f"I{number}"] = number
        self.ops.append(f"q {w * _PT:.2f} 0 0 {h * _PT:.2f} {x * _PT:.2f} {(PAGE_H - y - h) * _PT:.2f} cm /I{number} Do Q".encode())


class Writer:
    """Writes objects as they come, so that a document of many pages takes little memory."""

    def __init__(self, out: BinaryIO):
        self.out, self.at, self.places, self.pages = out, 0, {}, []
        self._put(b"%PDF-1.4\n%\xe2\xe3\xcf\xd3\n")
        self.last = 3  # 1 the catalogue, 2 the pages, 3 the font
        self._object(3, b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>")

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def _object(self, number: int, body: bytes) -> None:
        self.places[number] = self.at
        self._put(b"%d 0 obj\n%s\nendobj\n" % (number, body))

    def _next(self, body: bytes) -> int:
        self.last += 1
        self._object(self.last, body)
        return self.last

    def jpeg(self, data: bytes, width: int, height: int, channels: int = 3) -> int:
        space = b"/DeviceRGB" if channels == 3 else b"/DeviceGray"
        return self._next(b"<< /Type /XObject /Subtype /Image /Width %d /Height %d /ColorSpace %s /BitsPerComponent 8 /Filter /DCTDecode /Length %d >>\nstream\n%s\nendstream" % (width, height, space, len(data), data))

    def add(self, page: Page) -> None:
        ops = b"0.5 w\n" + b"\n".join(page.ops)
        content = self._next(b"<< /Length %d >>\nstream\n%s\nendstream" % (len(ops), ops))
        images = b" ".join(b"/%s %d 0 R" % (k.encode(), n) for k, n in page.images.items())
        self.pages.append(self._next(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %.2f %.2f] /Resources << /Font << /F 3 0 R >> /XObject << %s >> >> /Contents %d 0 R >>" % (PAGE_W * _PT, PAGE_H * _PT, images, content)))

    def close(self) -> None:
        self._object(2, b"<< /Type /Pages /Kids [%s] /Count %d >>" % (b" ".join(b"%d 0 R" % p for p in self.pages), len(self.pages)))
        self._object(1, b"<< /Type /Catalog /Pages 2 0 R >>")
        at = self.at
        rows = b"".join(b"%010d 00000 n \n" % self.places[i] for i in range(1, self.last + 1))
        self._put(b"xref\n0 %d\n0000000000 65535 f \n%strailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (self.last + 1, rows, self.last + 1, at))
