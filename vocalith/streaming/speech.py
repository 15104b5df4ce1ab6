"""Cutting speech out of a running sample clock, with bounded memory."""

from __future__ import annotations

from dataclasses import dataclass, field

PAD, LONGEST, RING = 3_200, 480_000, 19_840


class ProtocolError(ValueError):
    """Input that breaks the order of begins, ends and samples; the state is not to be used on."""


@dataclass
class SpeechCutter:
    """Spans (start, end, pcm_start) out of begins, ends and the number of samples that have come.

    A span begins with up to ``PAD`` samples from before its start (pcm_start), never from before the end of the last one; as soon as
    ``LONGEST`` samples from pcm_start are there it is cut, and goes on without padding. Between spans the last ``RING`` samples stay.
    """

    available: int = 0
    watermark: int = 0
    forced: bool = False
    cursor: int | None = None
    pcm_start: int = 0
    cut: bool = False
    spans: list[tuple[int, int, int]] = field(default_factory=list)

    @property
    def oldest(self) -> int:
        """First sample that is still held."""
        return self.pcm_start if self.cursor is not None else max(self.watermark, self.available - RING)

    def advance(self, samples: int) -> None:
        if samples < 0:
            raise ProtocolError("the clock ran back")
        self.available += samples
        self._release(self.available)

    def begin(self, at: int) -> None:
        if self.cursor is not None:
            raise ProtocolError("a span is open")
        if at == self.watermark or (at < self.watermark and self.forced and self.watermark - at <= PAD):
            start = first = self.watermark
        elif at < self.watermark:
            raise ProtocolError("a begin before the last end")
        else:
            start, first = at, max(self.watermark, at - PAD)
        if first < self.oldest:
            raise ProtocolError("the samples of this begin are gone")
        self.cursor, self.pcm_start, self.cut = start, first, False
        self._release(self.available)

    def complete(self, at: int) -> None:
        if self.cursor is None:
            raise ProtocolError("no span is open")
        if at > self.available:
            raise ProtocolError("an end ahead of the clock")
        if at < self.cursor:
            if not self.cut or self.cursor - at > PAD:
                raise ProtocolError("an end before its begin")
            at = self.cursor
        self._release(at)
        if at > self.cursor:
            self.spans.append((self.cursor, at, self.pcm_start))
        elif not self.cut:
            raise ProtocolError("an empty span")
        self.watermark, self.forced, self.cursor = at, self.cut, None

    def _release(self, until: int) -> None:
        while self.cursor is not None and until - self.pcm_start >= LONGEST:
            end = self.pcm_start + LONGEST
            self.spans.append((self.cursor, end, self.pcm_start))
            self.cursor = self.pcm_start = self.watermark = end
            self.forced = self.cut = True

    def take(self) -> list[tuple[int, int, int]]:
        out, self.spans = self.spans, []
        return out
