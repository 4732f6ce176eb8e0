"""Chat formatting with typed content parts.

A turn is a list of parts: text, image, audio, document.  A visitor walks them in order: text is escaped and written, any
other part becomes a placeholder with its number, an attachment reference, and the number of tokens it expands to.  A
conversation is the concatenation of its rendered turns::

    <|turn|>role\\ncontent<|end|>\\n

Control strings inside roles and texts are broken up by a backslash after their first character, and backslashes are
doubled, so nothing in a text can open or close a turn, and ``unescape`` gives the text back.  The loss mask covers the
text of assistant turns.

Reading back is a stream: ``Reader`` takes rendered turns one after the other and holds one turn at a time, so a
conversation of any length needs bounded memory.

Defined cases: a NULL text is empty, a NULL role is the empty role; turns are ordered by turn (NULL first), then role and
the texts of their parts, repeated rows included; rows without a conversation id are one conversation with a NULL id; parts
of unknown kind or NULL parts are written as document placeholders without reference.  Sizes that are NULL, zero or negative
count as one patch or page, seconds that are NULL, negative, NaN or infinite as one token.  A conversation of any length is read
in one task, a turn at a time, since its digests are sequential; turns without rows are none.
"""

from __future__ import annotations

import hashlib
import math
import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platelake.llm.ids import as_key, from_key

CONTROLS = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = re.compile("|".join(re.escape(c) for c in sorted(CONTROLS, key=len, reverse=True)))
_TURN = re.compile(r"<\|turn\|>([^\n]*)\n(.*?)<\|end\|>\n", re.S)
_PLACE = re.compile(r"<\|(?:image|audio|document):\d+\|>")
PART = "struct<kind:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>"
PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 12.5, 1024


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


@dataclass
class Visitor:
    """Renders parts in order; ``number`` counts attachments through the conversation."""

    number: int = 0
    attachments: list[tuple[int, str, str | None, int]] = field(default_factory=list)

    def visit(self, part) -> str:
        kind = (part["kind"] if part is not None else None) or "document"
        return getattr(self, f"visit_{kind}", self.visit_document)(part)

    def visit_text(self, part) -> str:
        return escape(part["text"] or "")

    def visit_image(self, part) -> str:
        wide, high = (math.ceil((part[side] if (part[side] or 0) > 0 else PATCH) / PATCH) for side in ("width", "height"))
        return self._place("image", part, wide * high)

    def visit_audio(self, part) -> str:
        seconds = part["seconds"] or 0.0
        return self._place("audio", part, max(1, math.ceil(seconds * AUDIO_RATE)) if math.isfinite(seconds) else 1)

    def visit_document(self, part) -> str:
        pages = part["pages"] if part is not None else None
        return self._place("document", part, PAGE_TOKENS * max(1, pages or 1))

    def _place(self, kind: str, part, tokens: int) -> str:
        self.attachments.append((self.number, kind, part["uri"] if part is not None else None, tokens))
        self.number += 1
        return f"<|{kind}:{self.number - 1}|>"


def render(role: str | None, parts, visitor: Visitor) -> str:
    head = escape(role or "").replace("\n", "\\n")
    return f"<|turn|>{head}\n" + "".join(visitor.visit(p) for p in parts if parts is not None) + "<|end|>\n"


class Reader:
    """Digests of a conversation, read back from its rendered turns."""

    def __init__(self):
        self.rest, self.turns, self.chars, self.loss_chars = "", 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def feed(self, rendered: str) -> None:
        self.chars += len(rendered)
        self.rest += rendered
        while (m := _TURN.match(self.rest)) is not None:
            self.rest = self.rest[m.end():]
            role = unescape(re.sub(r"(?<!\\)((?:\\\\)*)\\n", "\\1\n", m[1]))
            text = "".join(map(unescape, _PLACE.split(m[2])))
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            if role == "assistant":
                self.loss_chars += len(text)
                self.loss.update(text.encode("utf-8", "surrogatepass"))

    def digest(self) -> tuple:
        if self.rest:
            raise ValueError("text left behind the last turn")
        return self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


DIGEST = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, "
          "attachments long, attachment_tokens long")
_NAMES = [c.split()[0] for c in DIGEST.split(", ")]


def text_parts(conversations: DataFrame) -> DataFrame:
    """Rows with a text column as turns of one text part."""
    null = {n: F.lit(None) for n in ("uri", "width", "height", "seconds", "pages")}
    part = F.struct(F.lit("text").alias("kind"), F.coalesce("text", F.lit("")).alias("text"),
                    *[v.alias(n) for n, v in null.items()])
    return conversations.select("conv_id", "turn", "role", F.array(part).cast(f"array<{PART}>").alias("parts"))


def ordered(turns: DataFrame) -> DataFrame:
    """All turns of a conversation in one partition, in order."""
    said = F.transform("parts", lambda p: F.coalesce(p["text"], F.lit("")))
    return (turns.select("conv_id", "turn", "role", "parts", said.alias("_said"), F.to_json("parts").alias("_all"))
            .repartition("conv_id").sortWithinPartitions("conv_id", "turn", F.coalesce("role", F.lit("")), "_said", "_all")
            .drop("_said", "_all"))


def formatted(turns: DataFrame) -> DataFrame:
    """Rendered turns in order: conv_id, turn, rendered, loss (text under the mask), attachments."""

    def run(batches):
        now, visitor = None, Visitor()
        for pdf in batches:
            rows = []
            for conv, turn, role, parts in zip(pdf["conv_id"], pdf["turn"], pdf["role"], pdf["parts"]):
                if conv != now:
                    now, visitor = conv, Visitor()
                visitor.attachments = []
                rendered = render(role, parts if parts is not None else [], visitor)
                rows.append((conv, turn, rendered, role == "assistant",
                             [dict(zip(("number", "kind", "uri", "tokens"), a)) for a in visitor.attachments]))
            yield pd.DataFrame(rows, columns=["conv_id", "turn", "rendered", "loss", "attachments"])

    schema = ("conv_id string, turn string, rendered string, loss boolean, attachments "
              "array<struct<number:int,kind:string,uri:string,tokens:long>>")
    return (ordered(turns).select(as_key("conv_id"), as_key("turn"), "role", "parts").mapInPandas(run, schema)
            .select(from_key("conv_id"), from_key("turn"), "rendered", "loss", "attachments"))


def digests(turns: DataFrame) -> DataFrame:
    """DIGEST of each conversation, read back from its formatted turns, which keep their order in the partition."""

    def run(batches):
        now, reader, kinds, tokens, open_ = None, Reader(), 0, 0, False
        for pdf in batches:
            rows = []
            for conv, rendered, found in zip(pdf["conv_id"], pdf["rendered"], pdf["attachments"]):
                if open_ and conv != now:
                    rows.append((now, *reader.digest(), kinds, tokens))
                if not open_ or conv != now:
                    now, reader, kinds, tokens, open_ = conv, Reader(), 0, 0, True
                reader.feed(rendered)
                kinds += len(found)
                tokens += sum(a["tokens"] for a in found)
            yield pd.DataFrame(rows, columns=_NAMES)
        if open_:
            yield pd.DataFrame([(now, *reader.digest(), kinds, tokens)], columns=_NAMES)

    found = formatted(turns).select(as_key("conv_id"), "rendered", "attachments").mapInPandas(
        run, DIGEST.replace("conv_id long", "conv_id string"))
    return found.select(from_key("conv_id"), *_NAMES[1:])
