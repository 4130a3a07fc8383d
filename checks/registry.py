"""One query per operator, over the whole supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import inputs as I
from citeflow.functions import markup
from citeflow.operators import completion, context, deletions, history, latent, prompts, rendering, sessions
from citeflow.operators import index as ix
from citeflow.operators import retrieval as rt
from citeflow.operators import vector_index as vx
from citeflow.operators.embedding import embed_text, fit_embedder, search, text_search
from citeflow.plans import answering
from citeflow.session import scratch_folder, written
from citeflow.settings import Settings
from citeflow.sources import corpus as corp
from citeflow.sources import log_files, logs, recent, statements, transcript
from citeflow.sources.chunk_store import read_chunk_store, write_chunk_store
from citeflow.streaming import answering as answering_stream
from citeflow.streaming import channels, split

K = 10
BOT_USER = "0"


def rounded(hits: DataFrame, *more: str) -> DataFrame:
    score = F.round(F.col("score").cast("double"), 6).alias("score")
    return hits.select("qid", "rank", score, "chunk_id", *more)


# --- sources ---------------------------------------------------------------------------------


def register_corpora(spark, sf):
    corp.register_corpus(I.corpus(spark, sf), "docs", "chunk")
    corp.register_corpus(corp.corpus_from_pages(I.pages(spark, sf)), "pages_corpus", "chunk")
    return corp.corpus_catalog(spark).filter(F.col("name").isin("docs", "pages_corpus"))


def corpus_catalog(spark, sf):
    """The catalogue, with what each corpus holds."""
    catalog = register_corpora(spark, sf)
    sizes = [
        spark.table(name).agg(F.count("*").alias("chunks"), F.sum(F.length(column)).alias("chars"))
        .select(F.lit(name).alias("name"), "chunks", "chars")
        for name, column in catalog.collect()
    ]
    held = sizes[0]
    for more in sizes[1:]:
        held = held.unionByName(more)
    return catalog.join(held, "name")


def corpus_select(spark, sf):
    table, _ = corp.corpus_select(spark, register_corpora(spark, sf), "docs")
    return table


def keyword_hits(spark, sf, k=K):
    return rt.keyword_search(I.corpus(spark, sf), I.questions(spark, sf), k)


def semantic_hits(spark, sf, k=K):
    """Benchmark questions by the meaning of their texts, over all documents."""
    return text_search(I.corpus(spark, sf), I.questions(spark, sf), k)


def stored_corpus(spark, sf):
    """All documents as a chunk store."""
    path, corpus = scratch_folder(spark, "chunks"), I.corpus(spark, sf)
    write_chunk_store(corpus, path)
    return read_chunk_store(spark, path, corpus.schema)


def stored_index(spark, sf):
    path = scratch_folder(spark, "index")
    ix.write_term_index(I.corpus(spark, sf), path)
    return ix.read_term_index(spark, path)


def search_projection(spark, sf):
    hits = written(keyword_hits(spark, sf), "hits")
    return rounded(
        rt.search_projection(hits, stored_corpus(spark, sf), ["document_title", "source_url"]),
        "document_title",
        "source_url",
    )


def content_fallback(spark, sf):
    docs = I.table(spark, sf, "documents")
    has_null = docs.select(
        "doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("text")).alias("chunk"), F.col("text").alias("content")
    )
    upper = docs.select("doc_id", F.col("text").alias("CONTENT"))
    none = docs.select("doc_id", "lang")
    cases = [
        corp.content_fallback(df, "body").select(
            F.lit(case).alias("case_name"), "doc_id", F.col("content_text").alias("content")
        )
        for case, df in (("null_chunk", has_null), ("upper", upper), ("none", none))
    ]
    return cases[0].unionByName(cases[1]).unionByName(cases[2])


def log_tail(spark, sf):
    return logs.log_tail(I.logs(spark, sf), "text")


def log_tail_by_source(spark, sf):
    docs = I.table(spark, sf, "documents").select("source", "doc_id", "text")
    lines = logs.log_lines(docs, "text")
    return logs.last_lines(lines, ["doc_id", "index"], by=["source"])


def log_tail_overall(spark, sf):
    return logs.last_lines(logs.log_lines(I.logs(spark, sf), "text"), ["doc_id", "index"])


DOCS_A_LOG = 1000


def log_file_tail(spark, sf):
    """The texts of a thousand documents of a source are a log file; each file is read from its end."""
    path = scratch_folder(spark, "logs")
    log = F.concat_ws("-", "source", F.floor(F.col("doc_id") / DOCS_A_LOG).cast("string"))
    docs = I.table(spark, sf, "documents").select(log.alias("log"), "doc_id", F.col("text").alias("value"))
    laid = docs.repartition("log").sortWithinPartitions("log", "doc_id").select("log", "value")
    laid.write.partitionBy("log").text(path)
    tail = log_files.log_file_tail(spark, path)
    return tail.select(F.regexp_extract("path", "log=([^/]*)/", 1).alias("log"), "from_end", "value")


def piped_query(spark, sf):
    listing = I.table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return statements.piped_query(listing, "EVENTS")


def like_filter_concat(spark, sf):
    return statements.like_filter_concat(I.pages(spark, sf), "url", "http://", "open ", "command")


def result_scan(spark, sf):
    docs = I.table(spark, sf, "documents")
    statements.remember_result(docs.groupBy("source", "lang").agg(F.count("*").alias("n")), "last_result")
    return statements.result_scan(spark, "last_result").filter(F.col("lang") == "en").select("source", "n")


def bound_parameters(spark, sf):
    sql = "SELECT conv_id, turn, ? AS model, concat(text, ?) AS prompt FROM {messages} WHERE role = ?"
    return statements.bound_query(
        spark, sql, ["it's", " -- ?", "user"], messages=I.table(spark, sf, "conversations")
    )


def answered_turns(spark, sf):
    rows = I.table(spark, sf, "conversations")
    asked = rows.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("question"))
    told = rows.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response")
    )
    return asked.join(told, ["conv_id", "turn"], "left")


def transcript_append(spark, sf):
    path = scratch_folder(spark, "transcript")
    answered = answered_turns(spark, sf)
    for batch, only_answered in ((0, False), (1, True), (1, True)):
        transcript.transcript_append(transcript.transcript_rows(answered, only_answered), path, batch)
    return transcript.read_transcript(spark, path)


def corpus_from_pages(spark, sf):
    return corp.corpus_from_pages(I.pages(spark, sf))


def chunk_documents(spark, sf):
    return corp.chunk_documents(I.logs(spark, sf), "text")


# --- retrieval -------------------------------------------------------------------------------


def keyword_search(spark, sf):
    return rounded(keyword_hits(spark, sf))


def keyword_search_indexed(spark, sf):
    return rounded(rt.keyword_search_indexed(stored_index(spark, sf), I.questions(spark, sf), K))


def keyword_search_segments(spark, sf):
    """As the search over one segment: half of the documents are appended, and the segments merged."""
    corpus, path = I.corpus(spark, sf), scratch_folder(spark, "index")
    late = F.col("chunk_id") % 2 == 1
    ix.write_term_index(corpus.where(~late), path)
    ix.append_term_index(corpus.where(late), path)
    ix.merge_term_index(spark, path)
    ix.drop_old_segments(spark, path)
    return rounded(rt.keyword_search_indexed(ix.read_term_index(spark, path), I.questions(spark, sf), K))


def semantic_search(spark, sf):
    return rounded(semantic_hits(spark, sf))


def default_search(spark, sf):
    return rounded(search(None, I.corpus(spark, sf), I.questions(spark, sf), K))


def both_legs(spark, sf, k):
    hits = written(rt.legs(semantic_hits(spark, sf, k), keyword_hits(spark, sf, k)), "hits")
    return rt.search_projection(hits, I.corpus(spark, sf), ["chunk"])


def hybrid_first_seen(spark, sf):
    return rounded(rt.hybrid_first_seen(both_legs(spark, sf, K), K), "leg", "chunk")


def hybrid_boosted(spark, sf):
    return rounded(rt.hybrid_boosted(both_legs(spark, sf, 2 * K), K), "leg", "chunk")


def hybrid_boosted_raw(spark, sf):
    return rounded(rt.hybrid_boosted(both_legs(spark, sf, 2 * K), K, normalize=None), "leg", "chunk")


def dedupe_by_text(spark, sf):
    listed = I.table(spark, sf, "documents").select(
        F.col("lang").alias("qid"), F.col("doc_id").alias("rank"), F.col("text").alias("chunk")
    )
    return rt.dedupe_by_text(listed)


def top_k_per_query(spark, sf):
    scored = I.table(spark, sf, "events").select(
        F.col("user_id").alias("qid"), "event_id", F.col("value").alias("score")
    )
    return rt.top_k_per_query(scored, K, [F.col("score").desc(), F.col("event_id")])


def union_all_ranked(spark, sf):
    return rounded(rt.union_all_ranked(semantic_hits(spark, sf), keyword_hits(spark, sf)), "leg")


def postings(spark, sf):
    return ix.postings(I.corpus(spark, sf))


def term_stats(spark, sf):
    return ix.term_stats(ix.postings(I.corpus(spark, sf)))


def corpus_stats(spark, sf):
    return ix.corpus_stats(I.corpus(spark, sf)).withColumn("mean_length", F.round("mean_length", 6))


def embedding(spark, sf):
    corpus = I.corpus(spark, sf)
    made = embed_text(fit_embedder(corpus), corpus.select("chunk_id", "chunk"), "chunk")
    weights = made.select("chunk_id", F.posexplode("vector").alias("dim", "w")).filter("w <> 0")
    return weights.select("chunk_id", "dim", F.round("w", 6).alias("weight")).filter("weight <> 0")


def semantic_text_search(spark, sf):
    """One model for corpus and questions, kept and used again."""
    corpus = I.corpus(spark, sf)
    return rounded(text_search(corpus, I.questions(spark, sf), K, fit_embedder(corpus)))


def semantic_search_ann(spark, sf):
    """Stored vectors in cells cut by hyperplanes, every cell probed."""
    return rounded(rt.semantic_search_ann(I.stored_vectors(spark, sf), I.question_vectors(spark, sf), K))


def semantic_search_latent(spark, sf):
    """Benchmark questions by learnt vectors, over all documents; the model is stored and read again."""
    path, corpus = scratch_folder(spark, "latent"), I.corpus(spark, sf)
    latent.write_latent(spark, latent.fit_latent(corpus), path)
    return rounded(latent.latent_search(corpus, I.questions(spark, sf), K, latent.read_latent(spark, path)))


def semantic_search_stored(spark, sf):
    """All stored vectors through the vector index, searched until no cell can hold a better one."""
    path = scratch_folder(spark, "vectors")
    vx.write_vector_index(I.stored_vectors(spark, sf), path)
    return rounded(vx.search(vx.read_vector_index(spark, path), I.question_vectors(spark, sf), K, exact=True))


# --- context, history, prompts ---------------------------------------------------------------


def found(spark, sf):
    hits = written(keyword_hits(spark, sf), "hits")
    columns = ["chunk", "document_title", "source_url"]
    results = rt.search_projection(hits, I.corpus(spark, sf), columns)
    return context.result_lists(I.questions(spark, sf), results, columns)


def context_web(spark, sf):
    text = context.context_web(F.col("results"), "chunk", "source_url")
    return found(spark, sf).select("qid", text.alias("context"))


def context_bot(spark, sf):
    text = context.context_bot(F.col("results"), "chunk", "source_url")
    return found(spark, sf).select("qid", text.alias("context"))


def citations_by_url(spark, sf):
    cited = context.citations_by_url(F.col("results"), "source_url", "document_title")
    return found(spark, sf).select("qid", F.inline(cited))


def url_default(spark, sf):
    url = F.col("source_url")
    case = F.col("chunk_id") % 4
    made = (
        F.when(case == 1, F.lit("  ")).when(case == 2, F.concat(F.lit(" \n"), url, F.lit(" ")))
        .when(case == 3, url)
    )
    return I.corpus(spark, sf).select("chunk_id", context.url_default(made).alias("url"))


def history_window(spark, sf):
    return history.history_window(I.messages(spark, sf), 4)


def history_window_recent(spark, sf):
    """As the window over the whole transcript, from the store of newest messages after three batches."""
    path, told = scratch_folder(spark, "recent"), I.messages(spark, sf)
    for b in range(3):
        recent.update_recent(told.filter(F.col("turn") % 3 == b), path, b)
    recent.drop_old_versions(spark, path)
    return recent.recent_window(spark, path, 4)


def strip_citations(spark, sf):
    tail = F.when(F.col("turn") % 2 == 0, F.lit("\nSources: [^1] x")).otherwise(F.lit(""))
    text = F.concat(F.lit("  "), "text", F.lit(" [^1][^12] \n"), tail)
    return I.table(spark, sf, "conversations").select(
        "conv_id", "turn", history.strip_citations(text).alias("content")
    )


def history_render(spark, sf):
    held = history.histories(history.history_window(I.messages(spark, sf), 4))
    return held.select("conv_id", history.history_render(F.col("history")).alias("history_text"))


def told(spark, sf, use_history=True):
    asked = I.web_questions(spark, sf).select(
        "qid", history.question_normalize(F.col("question"), "web").alias("question")
    )
    return history.with_history(asked, I.messages(spark, sf), 4, use_history)


def query_route(spark, sf):
    rewritten = F.concat(F.lit("rewritten: "), "question")
    on = history.query_route(told(spark, sf), rewritten).withColumn("use_history", F.lit(True))
    off = history.query_route(told(spark, sf, False), rewritten).withColumn("use_history", F.lit(False))
    return on.unionByName(off).select("use_history", "qid", "search_query", "chat_history")


def query_rewrite_prompt(spark, sf):
    prompt = prompts.rewrite_prompt(history.history_render(F.col("history")), F.col("question"))
    return told(spark, sf).select("qid", prompt.alias("prompt"))


def question_normalize(spark, sf):
    text = F.concat(F.lit("  It's "), "text", F.lit(" \n"))
    return I.table(spark, sf, "conversations").select(
        "conv_id",
        "turn",
        history.question_normalize(text, "web").alias("web"),
        history.question_normalize(text, "bot").alias("bot"),
    )


def prompt_web(spark, sf):
    text = context.context_web(F.col("results"), "chunk", "source_url")
    prompt = prompts.prompt_web(F.lit("[]"), text, F.col("question"))
    return found(spark, sf).select("qid", prompt.alias("prompt"))


def bot_prompts(spark, sf):
    text = context.context_bot(F.col("results"), "chunk", "source_url")
    cited = context.citations_by_url(F.col("results"), "source_url", "document_title")
    prompt = prompts.prompt_bot(text, cited, F.col("question"))
    return found(spark, sf).select("qid", prompt.alias("prompt"))


def complete(spark, sf):
    return completion.complete(bot_prompts(spark, sf), Settings()).select("qid", "response")


def model_select(spark, sf):
    provider = F.when(F.col("conv_id") % 2 == 0, F.lit("offline")).otherwise(F.lit("openai"))
    return I.table(spark, sf, "conversations").select(
        "conv_id", "turn", completion.model_select(provider, Settings().models).alias("model")
    )


def response_or_apology(spark, sf):
    case = F.col("response_id") % 4
    maybe = F.when(case == 1, F.lit("")).when(case > 1, F.col("response"))
    return I.responses(spark, sf).select(
        "response_id",
        completion.response_or_apology(maybe).alias("shown"),
        completion.is_answered(maybe).alias("stored"),
    )


# --- responses -------------------------------------------------------------------------------


def sources_split(spark, sf):
    response = F.col("response")
    return I.responses(spark, sf).select(
        "response_id",
        markup.body_part(response).alias("body"),
        markup.sources_part(response).alias("sources"),
    )


def list_spacing(spark, sf):
    response = F.col("response")
    spaced = markup.list_spacing(markup.body_part(response), markup.sources_part(response))
    return I.responses(spark, sf).select("response_id", spaced.alias("formatted"))


def citation_superscript(spark, sf):
    return I.responses(spark, sf).select(
        "response_id", markup.citation_superscript(F.col("response")).alias("display")
    )


def source_line_parse(spark, sf):
    cited = rendering.with_citations(I.responses(spark, sf))
    return cited.select("response_id", F.inline("entries"))


def citation_groups(spark, sf):
    cited = rendering.with_citations(I.responses(spark, sf))
    return cited.select("response_id", F.inline("groups")).withColumn("nums", F.array_join("nums", ","))


def citation_symbols(spark, sf):
    cited = rendering.with_citations(I.responses(spark, sf))
    text = markup.citation_symbols(F.col("body"), F.col("groups"))
    return cited.select("response_id", text.alias("text"))


def markdown_to_mrkdwn(spark, sf):
    return rendering.with_chat_text(rendering.with_citations(I.responses(spark, sf))).select(
        "response_id", F.col("chat_text").alias("text")
    )


def block_segment(spark, sf):
    texts = rendering.with_chat_text(rendering.with_citations(I.responses(spark, sf)))
    return rendering.block_rows(rendering.block_segment(texts), "text_blocks")


def references_block(spark, sf):
    return rendering.block_rows(rendering.with_blocks(I.responses(spark, sf)))


def paginate_blocks(spark, sf):
    pages = rendering.paginate_blocks(rendering.with_blocks(I.responses(spark, sf)))
    return pages.select("response_id", "page_no", F.size("blocks").alias("n_blocks"))


def fallback_text(spark, sf):
    pages = rendering.paginate_blocks(rendering.with_blocks(I.responses(spark, sf)))
    return pages.select("response_id", "page_no", "fallback_text")


def format_failure_fallback(spark, sf):
    bad = F.col("response_id") % 11 == 0
    pages = rendering.rendered_pages(I.responses(spark, sf), bad)
    return pages.select("response_id", "page_no", "fallback_text")


# --- sessions --------------------------------------------------------------------------------


def event_stream(spark, sf):
    schema = I.table(spark, sf, "events").schema
    # A pattern that only the table itself matches: a stream takes no plain file.
    return channels.read_events(spark, f"{sf}/event[s].parquet", schema)


EVENTS_A_SLICE = 1_000_000


def event_slices(spark, sf):
    """The events in slices of time, each a table of as many files as it takes, with a bounded number of events of any
    channel in each. Only channels that hold more than that make slices, so a channel is not met again and again because
    there are many others."""
    events = I.table(spark, sf, "events")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    large = events.groupBy("user_id").count().where(F.col("count") > EVENTS_A_SLICE)
    # fewer than one channel for every slice's worth of events
    rows = large.agg(F.sum("count")).first()[0] or 0
    parts = 1 + rows // EVENTS_A_SLICE
    cuts = []
    if parts > 1:
        # Nulls are one channel.
        told = events.join(F.broadcast(large.select(F.col("user_id").alias("_u"))), F.col("user_id").eqNullSafe(F.col("_u")))
        cuts = told.agg(F.percentile_approx(micros, [i / parts for i in range(1, parts)])).first()[0] or []
    at = F.size(F.filter(F.lit(cuts).cast("array<bigint>"), lambda c: c <= micros))
    for i in range(len(cuts) + 1):
        yield events.filter(at == i).repartitionByRange("ts", "event_id")


def slice_stream(spark, folder, schema):
    """Stream of a slice that is one batch however many bytes it has: its files arrive in no certain order."""
    return channels.read_events(spark, folder, schema, bytes_per_batch=1 << 62)


def message_filter(spark, sf):
    stream = sessions.message_filter(I.as_channel_events(event_stream(spark, sf)))
    return channels.run_to_end(stream.select("channel", "event_id", "text"), "messages")


def state_rows(spark, sf, path=None):
    """A slice after the other arrives, and the stream goes on from where it stopped: order of arrival is that of time."""
    path, folder = path or scratch_folder(spark, "state"), scratch_folder(spark, "events")
    for part in event_slices(spark, sf):
        part.write.mode("append").parquet(folder)
        stream = slice_stream(spark, folder, part.schema)
        rows = channels.run_to_end(channels.channel_state_stream(I.as_channel_events(stream)), "state", path)
    return rows


def split_state(spark, sf):
    """Past events are in the state before the stream begins; later ones arrive slice by slice."""
    path, folder = scratch_folder(spark, "state"), scratch_folder(spark, "events")
    half = I.table(spark, sf, "events").agg(
        F.percentile_approx(F.unix_micros(F.col("ts").cast("timestamp")), 0.5)
    ).first()[0]
    late = F.unix_micros(F.col("ts").cast("timestamp")) > F.lit(half)
    split.bootstrap(I.as_channel_events(I.table(spark, sf, "events").filter(~late)), path)
    for part in event_slices(spark, sf):
        part.filter(late).write.mode("append").parquet(folder)
        stream = slice_stream(spark, folder, part.schema)
        rows = split.channel_state_split(I.as_channel_events(stream), path)
    return rows, path


def channel_history_state_split(spark, sf):
    return split_state(spark, sf)[0].select("channel", "event_id", "kind", "epoch", "history_len")


def stored_history_split(spark, sf):
    return split.split_history(spark, split_state(spark, sf)[1])


def stored_history(spark, sf):
    """What each channel holds in the end, read from the stream's state."""
    path = scratch_folder(spark, "state")
    state_rows(spark, sf, path)
    return channels.stored_history(spark, path)


def channel_history_state(spark, sf):
    return state_rows(spark, sf).select("channel", "event_id", "kind", "epoch", "history_len")


def first_contact(spark, sf):
    return state_rows(spark, sf).filter("welcome").select("channel", "event_id")


def clear_history(spark, sf):
    return state_rows(spark, sf).filter("kind = 'clear'").select("channel", "event_id", "known", "notice")


def end_session(spark, sf):
    return state_rows(spark, sf).filter("kind = 'end'").select("channel", "event_id", "known", "notice")


def channel_history_state_batch(spark, sf):
    return sessions.channel_history_state(I.channel_events(spark, sf))


def first_contact_batch(spark, sf):
    return sessions.first_contact(I.channel_events(spark, sf)).select("channel", "event_id")


def clear_history_batch(spark, sf):
    return sessions.clear_history(I.channel_events(spark, sf))


def end_session_batch(spark, sf):
    return sessions.end_session(I.channel_events(spark, sf))


def self_join_filter(spark, sf):
    stream = sessions.self_join_filter(I.as_join_events(event_stream(spark, sf)), BOT_USER)
    return channels.run_to_end(stream, "joins")


def active_channels(spark, sf):
    stream = channels.active_channel_stream(I.as_channel_events(event_stream(spark, sf)))
    return channels.run_to_end(stream, "active")


def deletion_plan(spark, sf):
    return sessions.deletion_plan(I.channel_events(spark, sf))


def deletion_ledger(spark, sf):
    """The plan applied in two runs: in the first the second page of every fifth channel gives no answer."""
    plan, path = sessions.deletion_plan(I.channel_events(spark, sf)), scratch_folder(spark, "ledger")

    def broken(rows):
        if rows["channel"].iloc[0] % 5 == 0 and rows["page_no"].iloc[0] == 1:
            raise ConnectionError("no answer")
        return [None] * len(rows)

    deletions.apply_deletions(plan, path, broken)
    deletions.apply_deletions(plan, path, lambda rows: [None] * len(rows))
    return deletions.ledger(spark, path).select("channel", "end_event_id", "event_id", "page_no", "credential", "deleted", "wave")


def live_messages(spark, sf):
    """Messages that are left when the plan was applied."""
    events, path = I.channel_events(spark, sf), scratch_folder(spark, "ledger")
    deletions.apply_deletions(sessions.deletion_plan(events), path, lambda rows: [None] * len(rows))
    deletions.compact(spark, path)
    return deletions.live_messages(events, path).filter("kind = 'message'").select("channel", "event_id")


def purge_all(spark, sf):
    return sessions.purge_all(I.channel_events(spark, sf))


def purge_resets(spark, sf):
    return sessions.purge_resets(I.channel_events(spark, sf))


# --- whole plans -----------------------------------------------------------------------------


def answer_web(spark, sf):
    corpus = I.corpus(spark, sf)
    model = fit_embedder(corpus)
    return answering.answer_web(
        I.web_questions(spark, sf),
        I.messages(spark, sf),
        corpus,
        lambda q, k: text_search(corpus, q, k, model),
        lambda q, k: rt.keyword_search(corpus, q, k),
        Settings(num_messages=4),
    )


def bot_answers(spark, sf):
    corpus = I.corpus(spark, sf)
    return answering.answer_bot(
        I.questions(spark, sf), corpus, lambda q, k: rt.keyword_search(corpus, q, k), Settings()
    )


def answer_bot_default(spark, sf):
    """Answers over the default search, by meaning."""
    corpus = I.corpus(spark, sf)
    told = answering.answer_bot(I.questions(spark, sf), corpus, lambda q, k: text_search(corpus, q, k), Settings())
    return told.withColumn("citations", F.to_json("citations"))


def answer_bot_fallback(spark, sf):
    """A corpus that lacks the configured search column is answered from the next name that is there."""
    corpus = I.corpus(spark, sf)
    told = answering.answer_bot(
        I.questions(spark, sf), corpus, lambda q, k: rt.keyword_search(corpus, q, k), Settings(search_column="body")
    )
    return told.withColumn("citations", F.to_json("citations"))


def answer_bot_indexed(spark, sf):
    """Answers over the stored term index and the chunk store."""
    index = stored_index(spark, sf)
    told = answering.answer_bot(
        I.questions(spark, sf), stored_corpus(spark, sf), lambda q, k: rt.keyword_search_indexed(index, q, k), Settings()
    )
    return told.withColumn("citations", F.to_json("citations"))


def answer_bot(spark, sf):
    return bot_answers(spark, sf).withColumn("citations", F.to_json("citations"))


def answer_bot_pages(spark, sf):
    return answering.answer_pages(bot_answers(spark, sf)).select("response_id", "page_no", "fallback_text")


def user_messages(conversations: DataFrame) -> DataFrame:
    """User rows of conversations as chat events; the other rows come from the bot."""
    return conversations.select(
        F.col("conv_id").alias("channel"),
        (F.col("conv_id") * 10 + F.col("turn")).alias("event_id"),
        F.lit("message").alias("kind"),
        "text",
        F.when(F.col("role") != "user", F.lit("b1")).alias("bot_id"),
    )


def answer_stream(spark, sf):
    """As `answer_bot_indexed`, for a stream of messages."""
    index = stored_index(spark, sf)
    schema = I.table(spark, sf, "conversations").schema
    events = user_messages(channels.read_events(spark, f"{sf}/conversation[s].parquet", schema))
    told, _ = answering_stream.answer_stream(
        events, stored_corpus(spark, sf), lambda q, k: rt.keyword_search_indexed(index, q, k), Settings()
    )
    return told.select("conv_id", "turn", "role", "content")


QUERIES = {
    f.__name__: f
    for f in (
        corpus_catalog, corpus_select, search_projection, content_fallback, log_tail,
        log_tail_by_source, log_tail_overall, piped_query, like_filter_concat, result_scan,
        bound_parameters, transcript_append, corpus_from_pages, chunk_documents,
        keyword_search, keyword_search_indexed, keyword_search_segments, semantic_search, default_search,
        hybrid_first_seen, hybrid_boosted, hybrid_boosted_raw, dedupe_by_text, top_k_per_query,
        union_all_ranked, postings, term_stats, corpus_stats, semantic_search_ann,
        semantic_search_stored, semantic_search_latent,
        context_web, context_bot, citations_by_url, url_default,
        history_window, strip_citations, history_render, query_route, query_rewrite_prompt,
        question_normalize, prompt_web, complete, model_select, response_or_apology,
        sources_split, list_spacing, citation_superscript, source_line_parse, citation_groups,
        citation_symbols, markdown_to_mrkdwn, block_segment, references_block, paginate_blocks,
        fallback_text, format_failure_fallback,
        message_filter, channel_history_state, first_contact, clear_history, end_session,
        channel_history_state_batch, first_contact_batch, clear_history_batch, end_session_batch,
        self_join_filter, active_channels, deletion_plan, purge_all, purge_resets,
        answer_web, answer_bot, answer_bot_default, answer_bot_fallback, answer_bot_indexed,
        answer_bot_pages, semantic_text_search, stored_history, answer_stream,
        channel_history_state_split, stored_history_split, deletion_ledger, live_messages,
        history_window_recent, log_file_tail,
    )
} | {"embed_text": embedding, "prompt_bot": bot_prompts}
