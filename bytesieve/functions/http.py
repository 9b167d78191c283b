"""HTTP/1.x message heads as columns, and the cutter that keeps flow state on streams."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed list: request methods of HTTP/1.1, WebDAV and its versioning extension.
METHODS = (
    "BASELINE-CONTROL CHECKIN CHECKOUT CONNECT COPY DELETE GET HEAD LABEL LOCK MERGE "
    "MKACTIVITY MKCOL MKWORKSPACE MOVE OPTIONS PATCH POST PROPFIND PROPPATCH PUT REPORT "
    "SEARCH TRACE UNCHECKOUT UNLOCK UPDATE VERSION-CONTROL"
).split()

_BLANK_LINE = "\r\n\r\n"
# One grammar for buffers and for streams: the request line, the response line, the announced body.
_REQUEST = r"^(" + "|".join(METHODS) + r") +(\S+)(?: +HTTP\S*)? *\r\n"
_RESPONSE = r"^HTTP/\d\.\d +(\d{3})[^\r\n]*\r\n"
_ANNOUNCED = r"(?i)\r\ncontent-length: *(\d{1,18})\s*\r\n"
# The same for a single header line, and the line that announces chunks.
_LENGTH = r"(?i)content-length: *(\d{1,18})\s*\r\n$"
_CHUNKED = r"(?i)transfer-encoding:(?:.*,)?[ \t]*chunked\s*\r\n$"


def message_heads(df: DataFrame, data: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """First HTTP message of each buffer ``data``; buffers without a whole head give no row.

    Columns: ``keep``, kind (request or response), method, uri, status, head_bytes, body_bytes
    and ``complete``, whether the announced body has arrived. A buffer is a response exactly if
    it starts with ``HTTP``.
    """
    # One Latin-1 character per byte, so character positions are byte positions.
    text = F.decode(F.col(data), "ISO-8859-1")

    def found(pattern: str, group: int = 1) -> Column:
        return F.nullif(F.regexp_extract("_head", pattern, group), F.lit(""))

    heads = (
        df.select(*keep, F.length(data).alias("_size"), text.alias("_text"))
        .select(*keep, "_size", "_text", F.position(F.lit(_BLANK_LINE), F.col("_text")).alias("_end"))
        .select(*keep, "_size", F.when(F.col("_end") > 0, F.left("_text", F.col("_end") + 3)).alias("_head"))
    )
    is_response = F.startswith("_head", F.lit("HTTP"))
    fields = heads.select(
        *keep,
        "_size",
        is_response.alias("_response"),
        F.when(~is_response, found(_REQUEST)).alias("method"),
        F.when(~is_response, found(_REQUEST, 2)).alias("uri"),
        F.when(is_response, found(_RESPONSE)).cast("int").alias("status"),
        F.length("_head").cast("long").alias("head_bytes"),
        F.coalesce(found(_ANNOUNCED).cast("long"), F.lit(0).cast("long")).alias("body_bytes"),
    )
    message = F.struct(
        *keep,
        F.when(F.col("_response"), F.lit("response")).otherwise(F.lit("request")).alias("kind"),
        "method", "uri", "status", "head_bytes", "body_bytes",
        (F.col("head_bytes") + F.col("body_bytes") <= F.col("_size")).alias("complete"),
    )
    known = F.col("method").isNotNull() | F.col("status").isNotNull()
    return fields.select(F.inline(F.when(known, F.array(message))))


def _may_start(line: bytes) -> bool:
    """Whether an unfinished first line can still grow into one of a message."""
    word, blank, _ = line.decode("latin-1").partition(" ")
    if word.startswith("HTTP"):
        return re.match(r"^HTTP(/(\d(\.(\d)?)?)?)?$", word, re.ASCII) is not None
    return word in METHODS if blank else any(start.startswith(word) for start in (*METHODS, "HTTP", "\r\n"))


# What a cutter waits for: a first line, header lines, body bytes, or the parts of a chunked body.
FIRST, HEAD, BODY, CHUNK_SIZE, CHUNK, CHUNK_END, TRAILER = range(7)


class MessageCutter:
    """Takes a flow's bytes as they come and gives each HTTP message once it is whole.

    Nothing is held but the line that is being read and a few numbers: of header lines the first ``LINE_KEPT`` bytes, of
    bodies only how many bytes are due. So time is in proportion to the bytes, however they are cut into packets.
    Bodies end at their announced length or with their last chunk. Replies to HEAD and replies of status 1xx, 204 and 304
    have none, whatever they announce. Empty lines before a message are skipped. Bytes that can never become a message end
    the flow: it stays foreign, as it does behind an accepted CONNECT or upgrade, and all its further bytes are counted.

    ``asked`` lists the methods of requests that wait for their reply; both cutters of a conversation share it.
    """

    # Bytes of a header line that are looked at, and of a first line that are waited for.
    LINE_KEPT, LINE_MOST = 256, 1 << 20

    def __init__(self, state: dict | None = None, asked: list[str] | None = None):
        self.asked = [] if asked is None else asked
        state = state or {}
        self.stage: int = state.get("stage", FIRST)
        self.line = bytearray(state.get("line", "").encode("latin-1"))
        self.line_bytes: int = state.get("line_bytes", 0)
        self.found: tuple | None = tuple(state["found"]) if state.get("found") else None
        self.due: int = state.get("due", 0)
        self.announced: int | None = state.get("announced")
        self.chunked: bool = state.get("chunked", False)
        self.size: int = state.get("size", 0)
        self.foreign: bool = state.get("foreign", False)

    def state(self) -> dict:
        """Everything but ``asked``, as values that JSON can hold."""
        names = ("stage", "line_bytes", "found", "due", "announced", "chunked", "size", "foreign")
        return {name: getattr(self, name) for name in names} | {"line": self.line.decode("latin-1")}

    def unfinished(self) -> int:
        """Bytes taken of a message that is not whole yet."""
        return 0 if self.foreign else self.size

    def feed(self, data: bytes) -> list[tuple]:
        """Messages completed by ``data``: (kind, method, uri, status, bytes).

        Bytes that belong to no message are one last entry of kind ``foreign``.
        """
        messages: list[tuple] = []
        at, lost = 0, 0
        while at < len(data) and not self.foreign:
            if self.stage in (BODY, CHUNK):
                taken = min(self.due, len(data) - at)
                self.due -= taken
                self.size += taken
                at += taken
                if not self.due:
                    self._body_part_ended(messages)
                continue
            end = data.find(b"\n", at)
            piece = data[at : end + 1] if end >= 0 else data[at:]
            at += len(piece)
            self.size += len(piece)
            self.line_bytes += len(piece)
            ended = piece.endswith(b"\n") and (self.line + piece[-2:]).endswith(b"\r\n")
            if self.stage == FIRST:
                self.line += piece
                looked_at = self.line_bytes - len(piece) > 64
                if not ended and (self.line_bytes > self.LINE_MOST or not (looked_at or _may_start(bytes(self.line[:128])))):
                    self.foreign = True
            else:
                # The last byte is kept too: a line may end between two packets.
                whole = self.line + piece
                self.line = whole if len(whole) <= self.LINE_KEPT else whole[: self.LINE_KEPT - 1] + whole[-1:]
            if ended and not self.foreign:
                line = self.line.decode("latin-1")
                self.line, self.line_bytes = bytearray(), 0
                self._line_ended(line, messages)
        if self.foreign:
            lost = self.size + len(data) - at
            self.size, self.line, self.line_bytes, self.found = 0, bytearray(), 0, None
        if lost:
            messages.append(("foreign", None, None, None, lost))
        return messages

    def _line_ended(self, line: str, messages: list[tuple]) -> None:
        if self.stage == FIRST:
            if line == "\r\n":
                self.size = 0
                return
            request, response = re.match(_REQUEST, line, re.ASCII), re.match(_RESPONSE, line, re.ASCII)
            if line.startswith("HTTP") and response:
                self.found = ("response", None, None, int(response[1]))
            elif request and not line.startswith("HTTP"):
                self.found = ("request", request[1], request[2], None)
            else:
                self.foreign = True
            self.stage, self.announced, self.chunked = HEAD, None, False
        elif self.stage == HEAD:
            if line == "\r\n":
                self._head_ended(messages)
                return
            length = re.match(_LENGTH, line, re.ASCII)
            if length and self.announced is None:
                self.announced = int(length[1])
            self.chunked = self.chunked or re.match(_CHUNKED, line, re.ASCII) is not None
        elif self.stage == CHUNK_SIZE:
            size = re.match(r"^ *([0-9A-Fa-f]{1,15})[ \t]*(?:;|\r\n)", line, re.ASCII)
            if not size:
                self.foreign = True
                return
            self.due = int(size[1], 16)
            self.stage = CHUNK if self.due else TRAILER
        elif self.stage == CHUNK_END:
            self.foreign = line != "\r\n"
            self.stage = CHUNK_SIZE
        elif line == "\r\n":
            self._finish(messages)

    def _head_ended(self, messages: list[tuple]) -> None:
        kind, method, _, status = self.found
        tunnel = bare = False
        if kind == "request":
            self.asked.append(method)
        else:
            # An interim reply leaves its request waiting.
            interim = status // 100 == 1 and status != 101
            replied = "" if interim or not self.asked else self.asked.pop(0)
            tunnel = status == 101 or (replied == "CONNECT" and status // 100 == 2)
            bare = tunnel or replied == "HEAD" or status // 100 == 1 or status in (204, 304)
        if bare:
            self._finish(messages)
            self.foreign = tunnel
        elif self.chunked:
            self.stage = CHUNK_SIZE
        else:
            self.due = self.announced or 0
            self.stage = BODY
            if not self.due:
                self._finish(messages)

    def _body_part_ended(self, messages: list[tuple]) -> None:
        if self.stage == CHUNK:
            self.stage = CHUNK_END
        else:
            self._finish(messages)

    def _finish(self, messages: list[tuple]) -> None:
        messages.append((*self.found, self.size))
        self.stage, self.found, self.size = FIRST, None, 0


class ConversationCutter:
    """The cutters of both directions of a conversation and the place of the last packet of each.

    A place is (microseconds, path, number). A conversation that pauses for more than ``idle_us`` of packet time starts anew.
    """

    def __init__(self, idle_us: int, several_files: bool, state: dict | None = None):
        state = state or {"cutters": [None, None], "newest": [None, None], "asked": []}
        self.idle_us, self.several_files = idle_us, several_files
        self.asked: list[str] = state["asked"]
        self.cutters = [MessageCutter(cutter, self.asked) for cutter in state["cutters"]]
        self.newest = [tuple(place) if place else None for place in state["newest"]]

    def state(self) -> dict:
        return {"cutters": [c.state() for c in self.cutters], "newest": self.newest, "asked": self.asked}

    def end(self, kind: str = "freed") -> list[tuple]:
        """Give up what is unfinished: (side, place, (kind, method, uri, status, bytes)) at the last packet of each side."""
        lost = [(side, self.newest[side], (kind, None, None, None, c.unfinished())) for side, c in enumerate(self.cutters)]
        self.asked.clear()
        self.cutters = [MessageCutter(None, self.asked) for _ in range(2)]
        return [entry for entry in lost if entry[2][4]]

    def feed(self, side: int, place: tuple, payload: bytes) -> list[tuple]:
        """What a packet completes or loses, as in ``end``; one that belongs before the last one of its side is late."""
        last = self.newest[side]
        skipped = 0 if self.several_files else 2
        if last is not None and place[skipped:] < last[skipped:]:
            return [(side, place, ("late", None, None, None, len(payload)))]
        seen = [place[0] for place in self.newest if place]
        found = self.end() if seen and place[0] - max(seen) > self.idle_us else []
        self.newest[side] = place
        return found + [(side, place, entry) for entry in self.cutters[side].feed(payload)]
