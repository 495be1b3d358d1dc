"""Chat messages, arrays of (role, content), as text and as training targets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions.text import or_empty, rstrip

# Fixed value: the chat template for tokenizers that marks what an assistant writes.
GENERATION_TEMPLATE = (
    "{% for message in messages %}{{ '<|im_start|>' + message['role'] + '\\n' }}"
    "{% if message['role'] == 'assistant' %}{% generation %}{{ message['content'] + '<|endoftext|>' }}{% endgeneration %}"
    "{% else %}{{ message['content'] + '<|im_end|>\\n' }}{% endif %}{% endfor %}"
    "{% if add_generation_prompt %}{{ '<|im_start|>assistant\\n' }}{% endif %}"
)
MESSAGES = "array<struct<role:string,content:string>>"
# Fixed values of the chat markup.
START, END, EOS = "<|im_start|>", "<|im_end|>\n", "<|endoftext|>"
EMPTY_THINKING = "<think>\n\n</think>\n\n"
NO_THINK = "/no_think"


def template_for(installed: str | None, assistant_only_loss: bool) -> str | None:
    """The template to use: the installed one, unless a loss on assistant text needs marks that it lacks."""
    marked = installed is not None and "{% generation %}" in installed and "{% endgeneration %}" in installed
    return installed if marked or not assistant_only_loss else GENERATION_TEMPLATE


def header(role: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"))


def body(message: Column) -> Column:
    """A message's text with its end marker; an assistant's end differs."""
    return F.concat(or_empty(message["content"]), F.when(message["role"] == "assistant", EOS).otherwise(END))


def render(messages: Column, generation_header: bool = False) -> Column:
    text = F.array_join(F.transform(messages, lambda m: F.concat(header(m["role"]), body(m))), "")
    return F.concat(text, header(F.lit("assistant"))) if generation_header else text


def target_segments(messages: Column) -> Column:
    """(segment, is_target) in order: only what an assistant writes, and its end marker, is a target."""
    pair = lambda text, target: F.struct(text.alias("segment"), target.alias("is_target"))
    return F.flatten(F.transform(messages, lambda m: F.array(pair(header(m["role"]), F.lit(False)), pair(body(m), m["role"] == "assistant"))))


def last(messages: Column) -> Column:
    return F.try_element_at(messages, F.lit(-1))


def all_but_last(messages: Column) -> Column:
    return F.slice(messages, 1, F.greatest(F.size(messages) - 1, F.lit(0)))


def last_user_place(messages: Column) -> Column:
    """0-based place of the last user message, null without one."""
    return F.array_max(F.filter(F.transform(messages, lambda m, i: F.when(m["role"] == "user", i)), lambda i: i.isNotNull()))


def add_no_think(messages: Column) -> Column:
    """The tag after the last user message, unless the message holds it already; then the message stays as it is."""
    place = last_user_place(messages)

    def tagged(m: Column, i: Column) -> Column:
        here = (i == place) & ~F.contains(or_empty(m["content"]), F.lit(NO_THINK))
        content = F.concat(rstrip(or_empty(m["content"])), F.lit("\n\n" + NO_THINK))
        return F.struct(m["role"].alias("role"), F.when(here, content).otherwise(m["content"]).alias("content"))

    return F.transform(messages, tagged)


def rendering_failures(prompt: Column, completion: Column, thinking_prompt: Column, no_thinking_prompt: Column) -> Column:
    """Names of the template rules that rendered texts break."""
    empty = F.lit(EMPTY_THINKING)
    return F.array_compact(
        F.array(
            F.when(~F.endswith(prompt, F.lit(START + "assistant\n")), "prompt_missing_assistant_generation_header"),
            F.when(~F.startswith(completion, empty), "completion_missing_empty_thinking_prefix"),
            F.when(F.endswith(thinking_prompt, empty), "thinking_mode_was_prefilled_as_non_thinking"),
            F.when(~F.endswith(no_thinking_prompt, empty), "no_thinking_mode_missing_empty_thinking_prefix"),
        )
    )
