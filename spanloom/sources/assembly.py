"""A text put together from blocks, with the spans, tables and source segments of what was put in."""

from __future__ import annotations

from ..operators.layout import table_cells


class Assembly:
    """Blocks one after another, a separator between them; counts characters and bytes.

    Separators, and separators inside tables, are ``generated`` segments, all else ``unmapped``.
    """

    def __init__(self, separator: str = "\n"):
        self.separator, self.parts, self.char, self.byte = separator, [], 0, 0
        self.segments: list[dict] = []
        self.layout: list[dict] = []
        self.tables: list[dict] = []

    def _put(self, text: str, kind: str) -> dict:
        a, b = self.char, self.byte
        self.parts.append(text)
        self.char, self.byte = a + len(text), b + len(text.encode())
        span = {"start_char": a, "end_char": self.char, "start_byte": b, "end_byte": self.byte}
        if text:
            self.segments.append({"segment_id": f"{kind}:{len(self.segments)}", "kind": kind, **span})
        return span

    def _gap(self) -> None:
        if self.parts:
            self._put(self.separator, "generated")

    def block(self, role: str, text: str) -> None:
        if text:
            self._gap()
            self.layout.append({"span_id": f"block:{len(self.layout)}", "role": role, "page_number": 1, **self._put(text, "unmapped")})

    def table(self, rows: list[list[str]]) -> None:
        """Rows joined by line ends, cells by blanks. A table needs cells, and each cell text."""
        if not any(rows):
            raise ValueError("a table has no cell")
        if any(c == "" for r in rows for c in r):
            raise ValueError("a table cell is empty")
        self._gap()
        number, start, places = len(self.tables), (self.char, self.byte), []
        for k, row in enumerate(r for r in rows if r):
            if k:
                self._put("\n", "generated")
            at = self.char
            for c in row:
                places.append((at, at + len(c)))
                at += len(c) + 1
            self._put(" ".join(row), "unmapped")
        span = {"start_char": start[0], "end_char": self.char, "start_byte": start[1], "end_byte": self.byte}
        text, base = self.text[start[0] :], start[0]
        cells, char, byte = [], base, start[1]
        for r, c, a, b, labels in table_cells([r for r in rows if r], places):
            byte += len(text[char - base : a - base].encode())
            end = byte + len(text[a - base : b - base].encode())
            cells.append({"row_index": r, "column_index": c, "start_char": a, "end_char": b, "start_byte": byte, "end_byte": end, "header_labels": labels})
            char, byte = b, end
        name = f"table:{number}"
        self.tables.append({"table_id": name, "page_number": 1, **span, "cells": cells})
        self.layout.append({"span_id": name, "role": "table", "page_number": 1, **span})

    def prefix(self, text: str) -> None:
        """Text before all blocks, such as a mail's header; spans put in later count from behind it."""
        self._put(text, "unmapped")

    @property
    def text(self) -> str:
        return "".join(self.parts)
