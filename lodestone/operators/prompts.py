"""Prompt templates as data, rendered as expressions, and chains of them.

A body is a list of parts: text, ``$name`` for a variable, and functions that
build a part from columns (loops and conditions). Rendering concatenates, so a
prompt never leaves whole-stage code.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import preview

@dataclass(frozen=True)
class Template:
    name: str
    technique: str
    tags: tuple[str, ...]
    description: str
    system: str
    body: tuple
    required: tuple[str, ...]
    optional: dict = field(default_factory=dict)
    examples: tuple = ()
    version: str = "1.0.0"


def _each(name: str, parts: tuple) -> Callable[[dict[str, Column]], Column]:
    """A loop over an array of structs; ``.field`` stands for a field."""

    def build(given: dict[str, Column]) -> Column:
        if name not in given:
            return F.lit("")
        return F.array_join(F.transform(given[name], lambda x: F.concat(*[x[p[1:]] if p.startswith(".") else F.lit(p) for p in parts])), "")

    return build


def _examples_of_labels(given: dict[str, Column]) -> Column:
    if "examples" not in given:
        return F.lit("")
    loop = _each("examples", ("Text: ", ".text", "\nLabel: ", ".label", "\n\n"))(given)
    return F.when(F.size(given["examples"]) > 0, F.concat(F.lit("Examples:\n"), loop)).otherwise("")


def _labels(given: dict[str, Column]) -> Column:
    return F.array_join(given["labels"], ", ")


def _context_note(given: dict[str, Column]) -> Column:
    if "context" not in given:
        return F.lit("")
    return F.when(F.length(given["context"]) > 0, F.concat(F.lit("Conversation context: "), given["context"], F.lit("\n"))).otherwise("")


# The wording of the templates.
TEMPLATES = {
    t.name: t
    for t in (
        Template(
            "rag_qa", "standard", ("rag", "qa", "retrieval"), "Standard RAG question answering using retrieved context.",
            "You are a helpful assistant that answers questions using only the provided context. If the context does not contain enough information to answer the question, say so clearly. Do not make up information.",
            ("Context:\n", "$context", "\n\nQuestion: ", "$question", "\n\nAnswer based only on the context above:"), ("context", "question"),
        ),
        Template(
            "rag_qa_cot", "chain-of-thought", ("rag", "qa", "chain-of-thought", "reasoning"),
            "RAG question answering with chain-of-thought reasoning. The model thinks step by step before giving the final answer.",
            "You are a careful, analytical assistant. When answering questions, you first reason through the evidence step by step, then give your final answer. Use only the provided context — do not use outside knowledge.",
            ("Context:\n", "$context", "\n\nQuestion: ", "$question",
             "\n\nLet's think step by step:\n1. What does the context tell us about this question?\n2. What is directly stated vs what is implied?\n3. What is the most accurate answer based on the context?\n\nReasoning:\n[think through the above steps]\n\nFinal Answer:"),
            ("context", "question"),
        ),
        Template(
            "rag_qa_few_shot", "few-shot", ("rag", "qa", "few-shot", "examples"),
            "RAG QA with few-shot examples showing the expected answer format. Examples guide the model on length, style, and citation behavior.",
            "You are a precise assistant. Answer questions using only the provided context. Follow the format shown in the examples.",
            ("Here are examples of good answers:\n\n", _each("examples", ("Context: ", ".context", "\nQuestion: ", ".question", "\nAnswer: ", ".answer", "\n\n")),
             "---\nNow answer this:\n\nContext:\n", "$context", "\n\nQuestion: ", "$question", "\n\nAnswer:"),
            ("context", "question"), {"examples": ()},
            (
                {"context": "The Eiffel Tower was built between 1887 and 1889.", "question": "When was the Eiffel Tower built?", "answer": "The Eiffel Tower was built between 1887 and 1889."},
                {"context": "Python was created by Guido van Rossum and first released in 1991.", "question": "Who created Python?", "answer": "Python was created by Guido van Rossum."},
            ),
        ),
        Template(
            "summarize", "standard", ("summarization", "compression"), "Summarize a document into a concise paragraph.",
            "You are an expert at distilling complex documents into clear, accurate summaries. Preserve key facts and main ideas.",
            ("Summarize the following document in ", "$max_sentences", " sentences or fewer.\nFocus on the most important information.\n\nDocument:\n", "$document", "\n\nSummary:"),
            ("document",), {"max_sentences": 3},
        ),
        Template(
            "summarize_bullets", "standard", ("summarization", "bullets", "list"), "Summarize a document as bullet points.",
            "You are an expert summarizer. Extract the key points from documents as a clear, scannable bullet list.",
            ("Extract the ", "$num_bullets", " most important points from this document as bullet points.\nEach bullet should be one concise sentence.\n\nDocument:\n", "$document", "\n\nKey points:\n•"),
            ("document",), {"num_bullets": 5},
        ),
        Template(
            "extract_json", "extraction", ("extraction", "json", "structured-output"),
            "Extract structured information from text and return as JSON. Provide a JSON schema describing what to extract.",
            "You are a precise data extraction assistant. Extract information from text and return ONLY valid JSON matching the provided schema. Do not include any explanation or markdown — output raw JSON only.",
            ("Extract the following information from the text below.\n\nSchema:\n", "$schema", "\n\nText:\n", "$text", "\n\nReturn ONLY the JSON object, no other text:"), ("text", "schema"),
        ),
        Template(
            "classify", "classification", ("classification", "labeling"), "Classify text into one of the provided labels.",
            "You are a precise classifier. Assign exactly one label from the provided list. Output ONLY the label — no explanation.",
            ("Classify the following text into exactly one of these labels:\n", _labels, "\n\n", _examples_of_labels, "Text to classify:\n", "$text", "\n\nLabel:"),
            ("text", "labels"), {"examples": ()},
        ),
        Template(
            "query_rewrite", "query-expansion", ("retrieval", "query", "rewriting", "expansion"),
            "Rewrite a user query to improve retrieval quality. Expands abbreviations, adds context, clarifies ambiguity.",
            "You are a search query optimizer. Rewrite queries to be more specific and retrieval-friendly. Expand abbreviations, add relevant keywords, and remove ambiguity. Return ONLY the rewritten query.",
            ("Original query: ", "$query", "\n\n", _context_note,
             "\nRewrite this query to improve document retrieval. Make it more specific and include relevant keywords. Output ONLY the rewritten query:"),
            ("query",), {"context": None},
        ),
        Template(
            "answer_grading", "evaluation", ("evaluation", "grading", "faithfulness", "rag"),
            "Grade an LLM answer for faithfulness to source context. Used in RAG evaluation pipelines.",
            "You are an expert evaluator assessing LLM answer quality. Be strict and objective.",
            ("You are evaluating whether an answer is faithful to the source context.\n\nContext (ground truth):\n", "$context", "\n\nQuestion: ", "$question", "\n\nAnswer to evaluate:\n", "$answer",
             "\n\nEvaluate on these criteria:\n1. FAITHFULNESS: Is every claim in the answer supported by the context?\n2. COMPLETENESS: Does the answer address the question fully?\n"
             "3. HALLUCINATION: Does the answer include information not in the context?\n\nRespond with a JSON object:\n{\n  \"faithfulness_score\": <0-10>,\n  \"completeness_score\": <0-10>,\n"
             "  \"hallucination_detected\": <true/false>,\n  \"issues\": [\"list of specific problems, or empty\"],\n  \"verdict\": \"<pass|fail>\",\n  \"explanation\": \"<one sentence summary>\"\n}"),
            ("context", "question", "answer"),
        ),
        Template(
            "hypothetical_doc", "hyde", ("retrieval", "hyde", "hypothetical", "embedding"),
            "Generate a hypothetical document that would answer a query. Used in HyDE retrieval: embed the hypothetical doc instead of the query, then search for real documents similar to the hypothetical.",
            "You are a document generator. Write realistic-sounding document excerpts that would contain the answer to the given question. Write as if it were an actual document, not a direct answer.",
            ("Write a short document excerpt (2-3 sentences) that would contain the answer to this question. Write it as a factual passage, not as a direct answer to the question.\n\nQuestion: ", "$question", "\n\nDocument excerpt:"),
            ("question",),
        ),
    )
}


def template(name: str) -> Template:
    if name not in TEMPLATES:
        raise ValueError(f"unknown template {name!r}; there are {', '.join(TEMPLATES)}")
    return TEMPLATES[name]


def registry(spark, tag: str | None = None, technique: str | None = None) -> DataFrame:
    """The templates as a table, by name; a tag or technique limits it."""
    rows = [(t.name, t.version, t.technique, list(t.tags), t.description, list(t.required), list(t.optional)) for t in TEMPLATES.values()]
    table = spark.createDataFrame(rows, "name string, version string, technique string, tags array<string>, description string, required array<string>, optional array<string>")
    if tag is not None:
        table = table.filter(F.array_contains("tags", tag))
    return (table if technique is None else table.filter(F.col("technique") == technique)).orderBy("name")


def techniques(spark) -> DataFrame:
    return registry(spark).agg(F.sort_array(F.collect_set("technique")).alias("techniques"))


def missing(name: str, given) -> list[str]:
    return [v for v in template(name).required if v not in given]


def rendered(rows: DataFrame, name: str, variables: dict[str, str | Column], out: str = "prompt") -> DataFrame:
    """``rows`` with the user message of a template. ``variables`` maps its
    variables to columns; optional ones fall back to their defaults, and empty
    examples to the template's own. A required one missing is an error; a null
    value renders as nothing."""
    made = template(name)
    lacking = missing(name, variables)
    if lacking:
        raise ValueError(f"template {name!r} lacks {', '.join(lacking)}")
    given = {k: F.col(v) if isinstance(v, str) else v for k, v in variables.items()}
    for k, default in made.optional.items():
        if k not in given and default not in ((), None):
            given[k] = F.lit(default)
    if made.examples:
        own = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in e.items()]) for e in made.examples])
        given["examples"] = F.when(F.size(given["examples"]) > 0, given["examples"]).otherwise(own) if "examples" in given else own

    def part(p) -> Column:
        if callable(p):
            return p(given)
        return F.coalesce(given[p[1:]].cast("string"), F.lit("")) if p.startswith("$") else F.lit(p)

    return rows.withColumn(out, F.concat(*[part(p) for p in made.body]))


def reply(prompt: Column) -> Column:
    """A stand-in for a model."""
    return F.concat(F.lit("[Mock] Response to: "), F.substring(prompt, 1, 80))


# Steps: template, where its variables come from, the name of its output.
CHAINS = {
    "rag_with_rewrite": [("query_rewrite", {"query": "question"}, "rewritten_query"), ("rag_qa", {"question": "rewritten_query", "context": "context"}, "answer")],
    "summarize_then_answer": [("summarize", {"document": "context", "max_sentences": "max_sentences"}, "summary"), ("rag_qa", {"question": "question", "context": "summary"}, "answer")],
}


def chained(rows: DataFrame, name: str, llm: Callable[[Column], Column] = reply) -> DataFrame:
    """``rows`` with the output of each step of a chain, which later steps can
    use, and previews of 200 characters. A column that a step lacks is an
    error; max_sentences is 3 where there is no such column."""
    if name not in CHAINS:
        raise ValueError(f"unknown chain {name!r}; there are {', '.join(CHAINS)}")
    for number, (step, sources, out) in enumerate(CHAINS[name], 1):
        sources = {k: v for k, v in sources.items() if not (k in template(step).optional and v not in rows.columns)}
        lacking = [v for v in sources.values() if v not in rows.columns]
        if lacking:
            raise ValueError(f"step {number} of chain {name!r} lacks {', '.join(lacking)}")
        rows = rendered(rows, step, sources, "__prompt").withColumn(out, llm(F.col("__prompt"))).withColumn(f"{out}_preview", preview(F.col(out), 200)).drop("__prompt")
    return rows


def numbered_context(rows: DataFrame, key: str, order: str, source: str, text: str) -> DataFrame:
    """Retrieved chunks of each key as one context, '[i] Source: s' above each."""
    parts = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(source).alias("s"), F.col(text).alias("t"))))
    joined = F.array_join(F.transform(parts, lambda p, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] Source: "), p["s"], F.lit("\n"), p["t"])), "\n\n")
    return rows.groupBy(key).agg(joined.alias("context"))
