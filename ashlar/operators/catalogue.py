"""The whole rule catalogue: the first rules of ``rules`` and, here, the rest by group.

Slugs, categories and severities are fixed values that policies and triage name; labels,
patterns and guards are this package's own. ``guard`` is a pattern that the file must hold,
``path`` one that its path must, ``anchors`` literals of which a file with a match holds one.
"""

from __future__ import annotations

from .rules import AGENT, API, EMB, GW, INFRA, LOCAL, RAG, RULES, SEC, TUNE, Rule, _sdk

_MODEL = r"(?i)openai|anthropic|langchain|litellm|llama|llm|gpt|claude|transformers|completion"
_AGENT = r"(?i)agent|langchain|crewai|autogen|langgraph|tool"
_LOADER = r"(?i)torch|transformers|keras|tensorflow|onnx|mlflow|joblib|pickle"
_ANSWER = r"(?:response|output|completion|answer|generated|llm_\w+|result)"
_USER = r"(?:user_\w+|request|query|question|input)"
_CLOUD = r"(?i)aws[-_]cdk|pulumi|constructs|boto3|aws_cdk"

#: Model services, runtimes, stores and training.
SERVICES = (
    Rule("azure_openai", API, "Hosted model calls, Azure", 3, r"AzureOpenAI\(|azure\.ai\.openai|AZURE_OPENAI_\w+|azure_endpoint\s*=", anchors=("azure",)),
    Rule("together_ai", API, "Hosted model calls", 2, r"api\.together\.(?:xyz|ai)|TOGETHER_API_KEY|Together(?:Client)?\(", anchors=("together",)),
    Rule("aws_bedrock", API, "Hosted model calls, AWS", 3, r"bedrock-runtime|\binvoke_model\(|BedrockChat|ChatBedrock", anchors=("bedrock", "invoke_model")),
    Rule("azure_ai_foundry", API, "Hosted model calls, Azure", 3, r"azure\.ai\.(?:inference|projects)|ChatCompletionsClient\(|AIProjectClient\(", anchors=("azure.ai.", "chatcompletionsclient", "aiprojectclient")),
    _sdk("ctransformers", "ctransformers", LOCAL, "Model run in process", 3), _sdk("exllamav2", "exllamav2", LOCAL, "Model run in process", 3, r"ExLlamaV2\w*\("), _sdk("auto_gptq", "auto_gptq", LOCAL, "Quantised model run in process", 3, r"AutoGPTQ\w+", r"GPTQConfig\("),
    Rule("hf_embeddings", EMB, "Text to vectors", 3, r"HuggingFace(?:Instruct|BGE)?Embeddings\(", anchors=("huggingface",)),
    Rule("cohere_embeddings", EMB, "Text to vectors", 2, r"CohereEmbeddings\(|\bco(?:here)?\.embed\(", anchors=("cohereembeddings", "co.embed(", "cohere.embed(")),
    Rule("google_embeddings", EMB, "Text to vectors", 2, r"(?:GoogleGenerativeAI|VertexAI)Embeddings\(|embed(?:ding)?-gecko", anchors=("embeddings(", "-gecko")),
    Rule("elasticsearch_vector", RAG, "Vectors in a search index", 3, r"dense_vector|knn_search\(|ElasticsearchStore\(", anchors=("dense_vector", "knn_search", "elasticsearchstore")),
    Rule("rag_pattern", RAG, "Retrieval before an answer", 3, r"RetrievalQA|ConversationalRetrievalChain|get_relevant_documents\(|as_retriever\(|create_retrieval_chain\(", guard=_MODEL, anchors=("retriev", "get_relevant_documents")),
    Rule("transformers_trainer", TUNE, "Training of a model", 2, r"\bTrainer\(|TrainingArguments\(|DataCollatorFor\w+\(", guard=r"(?i)transformers", anchors=("trainer(", "trainingarguments", "datacollator")),
    Rule("generic_finetune", TUNE, "Training script", 3, r"(?i)\bfine[-_ ]?tun(?:e|ing)\w*\s*\(|fine_tuning\.jobs", guard=_MODEL, anchors=("fine",)),
    Rule("helicone", GW, "Model calls through a proxy", 3, r"(?i)helicone\.ai|HELICONE_API_KEY|x?-?helicone-auth", anchors=("helicone",)),
    Rule("nocode_ai_platform", GW, "No-code model platform", 3, r"(?i)api\.dify\.ai|DIFY_API_KEY|flowiseai|/api/v1/prediction/|n8n-nodes-langchain", anchors=("dify", "flowise", "/prediction/", "n8n")),
    Rule("openai_assistants", AGENT, "Hosted assistants with functions", 2, r"\.beta\.(?:assistants|threads)|\bthreads\.runs?\.create|assistants\.create\(", anchors=("assistants", "threads")),
    Rule("dynamic_import_ai", API, "Model library loaded by name", 2, r"(?:import_module|__import__)\(\s*[\"'](?:openai|anthropic|langchain|cohere|transformers)\b", anchors=("import_module(", "__import__(")),
    Rule("dynamic_require_ai", API, "Library loaded by a variable", 3, r"\brequire\(\s*(?:provider|model|ai|llm)\w*\s*\)", guard=_MODEL, anchors=("require(",)),
    Rule("dynamic_attr_ai", API, "Model method by name", 3, r"globals\(\)\s*\[\s*[\"'](?:openai|anthropic|langchain)|getattr\([^)\n]*[\"'](?:chat|complete|generate)[\"']", anchors=("globals()", "getattr(")),
    Rule("openai_js", API, "Hosted model calls in JavaScript", 2, r"new\s+(?:Azure)?OpenAI\(|(?:from|require\()\s*[\"']openai[\"']", anchors=("openai",)),
    Rule("anthropic_js", API, "Hosted model calls in JavaScript", 2, r"@anthropic-ai/sdk|new\s+Anthropic\(", anchors=("anthropic",)),
    Rule("google_ai_js", API, "Hosted model calls in JavaScript", 2, r"@google/(?:generative-ai|genai)|new\s+GoogleGenerativeAI\(", anchors=("@google/", "googlegenerativeai")),
    Rule("vercel_ai_sdk", API, "Streamed model calls in JavaScript", 2, r"@ai-sdk/\w+|\b(?:streamText|generateText|useChat)\(", anchors=("@ai-sdk", "streamtext(", "generatetext(", "usechat(")),
    Rule("langchain_js", API, "Prompt chains in JavaScript", 2, r"@langchain/\w+|(?:from|require\()\s*[\"']langchain", anchors=("langchain",)),
    Rule("js_env_key_ref", API, "Key from the environment", 4, r"process\.env\.(?:OPENAI|ANTHROPIC|GEMINI|COHERE|GROQ|MISTRAL)_API_KEY", anchors=("process.env.",)),
    Rule("nextjs_ai_route", API, "Web route that calls a model", 3, r"export\s+async\s+function\s+(?:POST|GET)\b", guard=r"(?i)openai|anthropic|@ai-sdk|langchain|streamText", anchors=("export",)),
)

#: Credentials.
CREDENTIALS = (
    Rule("hardcoded_key", SEC, "Model key in source", 1, r"(?i)(?:OPENAI|ANTHROPIC|COHERE|GEMINI|GROQ|MISTRAL|HF)_(?:API_KEY|TOKEN)\s*=\s*[\"'][^\"'\s]{8,}[\"']", entropy=True, anchors=("_api_key", "_token")),
    Rule("js_hardcoded_key", SEC, "Model key in JavaScript", 1, r"\bapiKey\s*:\s*[\"'][A-Za-z0-9_-]{16,}[\"']", anchors=("apikey",)),
    Rule("aws_secret_key", SEC, "Cloud secret key", 1, r"(?i)aws_?secret_?(?:access_?)?key[\"']?\s*[:=]\s*[\"']?[A-Za-z0-9/+]{40}\b", anchors=("secret",)),
    Rule("slack_webhook", SEC, "Chat web hook", 1, r"https://hooks\.slack\.com/services/[A-Za-z0-9/]{20,}", anchors=("hooks.slack.com",)),
    Rule("sendgrid_key", SEC, "Mail service key", 1, r"\bSG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}", anchors=("sg.",)),
    Rule("twilio_key", SEC, "Telephony key", 1, r"\bSK[0-9a-f]{32}\b|(?i:twilio)\w*[\"']?\s*[:=]\s*[\"'][0-9a-f]{32}[\"']", anchors=("sk", "twilio")),
    Rule("mongodb_connection_string", SEC, "Database address with a password", 1, r"mongodb(?:\+srv)?://[^\s:@/\"']+:[^\s@/\"']+@", anchors=("mongodb",)),
    Rule("discord_webhook", SEC, "Chat web hook", 1, r"https://(?:ptb\.|canary\.)?discord(?:app)?\.com/api/webhooks/\d+/[\w-]{20,}", anchors=("/api/webhooks/",)),
    Rule("pypi_token", SEC, "Package index token", 1, r"pypi-[A-Za-z0-9_-]{50,}", anchors=("pypi-",)),
    Rule("hardcoded_credential_db", SEC, "Password in a database seed", 1, r"(?i)insert\s+into\s+\w*(?:user|account|login)\w*[^;\n]*\bpassw(?:or)?d\b[^;\n]*values", anchors=("insert",)),
)

#: Models that are loaded without a check.
LOADERS = (
    Rule("unsafe_torch_load", SEC, "Weights loaded as objects", 2, r"torch\.load\((?:(?!weights_only\s*=\s*True)[^)\n])*\)", guard=r"(?i)from_pretrained|transformers|checkpoint", anchors=("torch.load",)),
    Rule("unsafe_torch_load_bare", SEC, "Weights loaded as objects", 2, r"torch\.load\((?:(?!weights_only)[^)\n])*\)", anchors=("torch.load",)),
    Rule("unsafe_marshal", SEC, "Code objects are loaded", 1, r"marshal\.loads?\(", anchors=("marshal.load",)),
    Rule("pickle_reduce_exploit", SEC, "Object that runs code when loaded", 1, r"def\s+__reduce(?:_ex)?__\s*\(", anchors=("__reduce",)),
    Rule("unsafe_onnx_load", SEC, "Model graph loaded", 2, r"onnx\.load(?:_model)?\(|onnxruntime\.InferenceSession\(|ort\.InferenceSession\(", anchors=("onnx", "inferencesession")),
    Rule("unsafe_mlflow_load", SEC, "Model loaded from a registry", 2, r"mlflow\.\w+\.load_model\(", anchors=("mlflow.",)),
    Rule("unsafe_joblib_load", SEC, "Objects loaded from a file", 2, r"\bjoblib\.load\(", anchors=("joblib.load",)),
    Rule("framework_model_load", SEC, "Model loaded by a framework", 2, r"\bload_model\(|\.from_pretrained\(", guard=_LOADER, anchors=("load_model(", "from_pretrained(")),
    Rule("bentoml_pickle_load", SEC, "Pickled model loaded", 1, r"bentoml\.(?:picklable_model|sklearn|pytorch|tensorflow|xgboost)\.(?:load_model|get)\(", anchors=("bentoml.",)),
    Rule("opencv_model_load", SEC, "Vision model loaded", 2, r"cv2\.dnn\.readNet\w*\(", anchors=("cv2.dnn",)),
    Rule("gradient_boost_load", SEC, "Boosted trees loaded", 2, r"(?:CatBoost\w*|Booster)\([^)\n]*\)\.load_model\(|lgb\.Booster\(\s*model_file|(?:xgb|booster)\.load_model\(", anchors=("catboost", "booster", "xgb.")),
    Rule("remote_model_load", SEC, "Model loaded from the web", 2, r"(?:from_pretrained|load_model|torch\.hub\.load\w*)\(\s*[\"']https?://", guard=_LOADER, anchors=("://",)),
    Rule("unsafe_tf_load", SEC, "Model loaded with its code", 2, r"tf\.saved_model\.load\(|keras\.models\.load_model\(", anchors=("saved_model.load", "models.load_model")),
    Rule("unpinned_model", SEC, "Model without a revision", 3, r"\.from_pretrained\((?:(?!revision)[^)\n])*\)", guard=r"(?i)transformers|diffusers|sentence_transformers", anchors=("from_pretrained(",)),
)

#: Prompts, answers and what is done with them.
PROMPTS = (
    Rule("sql_injection_risk", SEC, "Query text made by a model", 2, rf"(?i)(?:execute|text)\(\s*{_ANSWER}\b|f[\"']\s*(?:select|insert|update|delete)\b[^\"'\n]*\{{", guard=_MODEL, anchors=("execute(", "text(", "select", "insert", "update", "delete")),
    Rule("sql_in_tool_description", SEC, "Query in a tool's description", 2, r"(?i)description\s*=\s*[^\n]*\bselect\b[^\n]*\bfrom\b", guard=_AGENT, anchors=("description",)),
    Rule("weak_config", SEC, "No bound on answers", 3, r"(?i)\bmax_(?:tokens|length|new_tokens)\s*=\s*None\b", guard=_MODEL, anchors=("max_",)),
    Rule("high_temperature", SEC, "Very free sampling", 3, r"(?i)\btemperature[\"']?\s*[=:]\s*(?:1\.[1-9]\d*|[2-9](?:\.\d+)?)\b", guard=_MODEL, anchors=("temperature",)),
    Rule("jinja_template_injection", SEC, "Template from user text", 1, rf"(?:Template|render_template_string|from_string)\(\s*(?:f[\"']|{_USER}\b)", guard=r"(?i)jinja|flask", anchors=("template", "from_string(")),
    Rule("dan_jailbreak_marker", SEC, "Name of a known override", 2, r"(?i)\bDAN mode\b|do anything now|\bdeveloper mode enabled\b|\bSTAN mode\b", anchors=("mode", "do anything now")),
    Rule("sqli_always_true", SEC, "Condition that always holds", 1, r"(?i)\bor\s+[\"']?1[\"']?\s*=\s*[\"']?1\b|\bor\s+[\"']a[\"']\s*=\s*[\"']a", anchors=("or ",)),
    Rule("sqli_char_casting", SEC, "Query text hidden in codes", 1, r"(?i)char\(\s*\d{2,3}\s*\)(?:\s*(?:\+|\|\||,)\s*char\(\s*\d{2,3}\s*\))+", anchors=("char(",)),
    Rule("unsafe_output_rendering", SEC, "Answer shown as markup", 2, rf"(?i)unsafe_allow_html\s*=\s*True|dangerouslySetInnerHTML|innerHTML\s*=\s*{_ANSWER}", anchors=("unsafe_allow_html", "innerhtml")),
    Rule("insecure_output_handling", SEC, "Answer reaches a dangerous call", 1, rf"(?i)(?:eval|exec|os\.system|subprocess\.\w+|innerHTML)\s*[(=]\s*{_ANSWER}\b", anchors=("eval", "exec", "os.system", "subprocess", "innerhtml")),
    Rule("llm_output_file_write", SEC, "Answer written to a file", 2, rf"(?i)\.write(?:_text)?\(\s*{_ANSWER}\b", guard=_MODEL, anchors=(".write",)),
    Rule("prompt_leakage", SEC, "System prompt is shown", 2, r"(?i)(?:print|return|display|show|jsonify)\s*\(?\s*[^\n=]*\bsystem_(?:prompt|message)\b", anchors=("system_",)),
    Rule("system_prompt_injection", SEC, "User text in the system prompt", 2, rf"(?i)system_(?:prompt|message)\s*(?:\+=|=[^\n]*(?:\+|\{{))\s*[^\n]*{_USER}", guard=_MODEL, anchors=("system_",)),
    Rule("pii_in_prompt", SEC, "Personal data in a prompt", 1, r"(?i)prompt\w*\s*[+=][^\n]*(?:social_security|ssn|credit_card|passport|date_of_birth)", guard=_MODEL, anchors=("prompt",)),
    Rule("rag_data_poisoning", SEC, "User text enters the index", 2, rf"(?i)(?:add_documents|add_texts|from_documents|from_texts|upsert)\(\s*[^)\n]*{_USER}", guard=_MODEL, anchors=("add_", "from_", "upsert(")),
    Rule("langchain_telemetry", SEC, "Traces leave for a service", 2, r"(?i)LANGCHAIN_TRACING(?:_V2)?[\"'\]]*\s*[=:]\s*[\"']?true|LANGSMITH_API_KEY", anchors=("langchain_tracing", "langsmith")),
    Rule("pyrit_markdown_injection", SEC, "Link with data in an answer", 2, r"\[[^\]\n]{0,200}\]\(https?://[^)\s]*(?:\{|%7B)", guard=_MODEL, anchors=("](http",)),
    Rule("pyrit_system_prompt_override", SEC, "Override written as a system message", 1, r"(?i)\[?(?:SYSTEM|ADMIN)\s+OVERRIDE\]?|BEGIN\s+(?:NEW\s+)?(?:SYSTEM\s+)?INSTRUCTIONS|new instructions?\s*:\s*(?:ignore|disregard)", anchors=("override", "begin", "new instruction")),
    Rule("pyrit_prefix_injection", SEC, "Answer begun for the model", 2, r"(?i)(?:start|begin) (?:your )?(?:answer|response|reply) with [\"']?(?:sure|absolutely|of course)", anchors=("with ",)),
    Rule("pyrit_eval_user_input", SEC, "User text is evaluated", 1, r"(?i)\beval\(\s*(?:request|req|input\(|user_\w+|params)", anchors=("eval(",)),
    Rule("pyrit_stack_trace_exposure", SEC, "Error detail in an answer", 2, r"(?i)(?:return|jsonify|send|Response)\b[^\n]*(?:traceback\.format_exc\(|str\(e(?:xc(?:eption)?)?\)|e\.args)", anchors=("traceback", "str(e", "e.args")),
    Rule("pyrit_debug_production", SEC, "Debug switch of a web application", 2, r"\bapp\.run\([^)\n]*debug\s*=\s*True|(?m:^DEBUG\s*=\s*True)", anchors=("debug",)),
    Rule("pyrit_phishing_language", SEC, "Wording of a phishing mail", 2, r"(?i)your account (?:has been|will be) (?:suspended|locked|closed)|verify your (?:account|identity) (?:now|immediately)", guard=r"(?i)prompt|template", anchors=("your ",)),
    Rule("pyrit_dos_loop", SEC, "Requests in a long loop", 2, r"(?i)for\s+\w+\s+in\s+range\(\s*\d{4,}[^)\n]*\)\s*:\s*\n?\s*[^\n]*(?:requests\.|urllib|socket)", guard=r"(?i)requests|urllib|socket", anchors=("range(",)),
    Rule("pyrit_ransomware_pattern", SEC, "Files encrypted in a loop", 1, r"(?i)(?:os\.walk|glob\.glob|rglob)\([^\n]*\n(?:[^\n]*\n){0,8}?[^\n]*(?:\.encrypt\(|Fernet\()", anchors=("encrypt(", "fernet(")),
)

#: Agents and their tools.
AGENTS = (
    Rule("llm_tool_no_authz", SEC, "Tool that may act for anyone", 2, r"(?:^|[^\w.])(?:Structured)?Tool\(|class\s+\w+\(BaseTool\)|@tool\b", guard=_AGENT, anchors=("tool",)),
    Rule("agent_loop_risk", SEC, "Agent without a limit of steps", 2, r"(?i)\bmax_(?:iterations|steps|turns)\s*=\s*(?:None|float\([\"']inf|[1-9]\d{3,})", guard=_AGENT, anchors=("max_",)),
    Rule("ssrf_via_llm_tool", SEC, "Address chosen by a model is fetched", 1, rf"(?i)(?:requests|httpx)\.(?:get|post|put|patch)\(\s*(?:url|tool_input|{_ANSWER})\b", guard=_AGENT, anchors=("requests.", "httpx.")),
    Rule("memory_injection", SEC, "User text stored in an agent's memory", 2, rf"(?i)(?:memory|chat_history|buffer)\.(?:save_context|add|append|add_\w+)\([^)\n]*{_USER}", guard=_AGENT, anchors=("memory.", "chat_history.", "buffer.")),
    Rule("no_human_in_loop", SEC, "No person has to agree", 2, r"(?i)(?:human_(?:approval|in_the_loop)|require_approval)\s*=\s*False|auto_approve\s*=\s*True|human_input_mode\s*=\s*[\"']NEVER", anchors=("human_", "approv")),
    Rule("tool_output_injection", SEC, "Tool result enters a prompt as it is", 2, r"(?i)(?:prompt|messages|content)\w*[\"']?\s*(?:\+=|[=:])[^\n]*(?:tool_(?:result|output)|function_result|observation)\b", guard=_AGENT, anchors=("tool_", "function_result", "observation")),
    Rule("document_embedded_instruction", SEC, "Document text enters a prompt as it is", 2, r"(?i)(?:prompt|messages)\w*\s*(?:\+=|=)[^\n]*(?:\.read\(\)|read_text\(\)|load_document\(|page_content)", guard=_MODEL, anchors=("prompt", "messages")),
    Rule("cross_context_injection", SEC, "Memory of one talk enters another", 2, r"(?i)(?:load_memory_variables\(|chat_history\.messages|Conversation(?:Buffer|Summary)\w*\()", guard=_AGENT, anchors=("load_memory", "chat_history", "conversation")),
    Rule("tool_schema_manipulation", SEC, "Tool described at run time", 2, r"(?i)(?:description|args_schema|parameters)\s*=\s*(?:f[\"'][^\"'\n]*\{|get_\w+\(|\w+\[)", guard=r"(?i)\btool", anchors=("description", "args_schema", "parameters")),
    Rule("tool_registry_poisoning", SEC, "Tools loaded by name", 2, rf"(?i)(?:load_tools|get_tool|tool_registry\.(?:get|register))\(\s*(?!\[?\s*[\"'])\w*|registry\[\s*{_USER}", guard=_AGENT, anchors=("load_tools", "get_tool", "registry")),
    Rule("insecure_inter_agent_msg", SEC, "One agent's words are another's orders", 2, rf"(?i)\bagent\w*\.(?:run|invoke|chat|step|send)\(\s*\w*(?:agent|{_ANSWER})\w*", guard=r"(?i)agent", anchors=("agent",)),
    Rule("agent_permission_inheritance", SEC, "Agent has all tools of its maker", 2, r"(?i)(?:AgentExecutor|initialize_agent|create_\w+_agent)\([^)\n]*tools\s*=\s*(?:all_tools|self\.tools|parent\.tools|tools\b)", anchors=("agentexecutor", "initialize_agent", "_agent(")),
    Rule("agent_runaway_autonomy", SEC, "Agent in an endless loop", 1, r"(?i)while\s+True\s*:\s*\n(?:[^\n]*\n){0,4}?[^\n]*\bagent\w*\.(?:run|step|invoke|act)\(", guard=r"(?i)agent", anchors=("while",)),
    Rule("agent_reward_hacking", SEC, "Agent sets its own measure", 3, r"(?i)(?:self|agent)\.(?:reward|score|fitness|metric)\w*\s*(?:\+=|=)\s*[^=\n]", guard=r"(?i)agent", anchors=("reward", "score", "fitness", "metric")),
    Rule("agent_collusion_risk", SEC, "Agents share a state that all write", 2, r"(?i)\b(?:shared_(?:memory|context|store|state)|global_state)\s*(?:\[|\.(?:update|append|set|write)\()", guard=r"(?i)agent", anchors=("shared_", "global_state")),
    Rule("shell_cmd_from_llm", SEC, "Shell command from an answer", 1, rf"(?i)(?:subprocess\.(?:run|call|Popen|check_output)|os\.system|os\.popen)\(\s*(?:\[[^\]\n]*)?{_ANSWER}\b", anchors=("subprocess.", "os.system", "os.popen")),
    Rule("eval_on_llm_output", SEC, "Answer is evaluated", 1, rf"(?i)\b(?:eval|exec|compile)\(\s*{_ANSWER}\b", anchors=("eval(", "exec(", "compile(")),
    Rule("dynamic_code_write_exec", SEC, "Code is written and then run", 1, r"(?i)(?:write_text|write_bytes|\.write)\([^\n]*\n(?:[^\n]*\n){0,6}?[^\n]*(?:subprocess\.|exec\(|os\.system|runpy)", guard=_MODEL, anchors=("write",)),
    Rule("excessive_tool_functionality", SEC, "Tool that can destroy", 2, r"(?i)@tool\b[^\n]*\n(?:[^\n]*\n){0,8}?[^\n]*(?:shutil\.rmtree|os\.(?:remove|unlink|rmdir)|subprocess\.|os\.system)", guard=_AGENT, anchors=("@tool",)),
    Rule("excessive_agent_permissions", SEC, "Agent with full rights", 1, r"(?i)(?:role|permission|access_level|scope)s?[\"']?\s*[=:]\s*[\"'](?:admin|root|superuser|full|\*)[\"']", guard=r"(?i)agent", anchors=("role", "permission", "access_level", "scope")),
    Rule("excessive_agent_autonomy", SEC, "Act without a question", 2, r"(?i)\b(?:confirm|verify|ask_before|require_confirmation)\w*\s*=\s*False", anchors=("confirm", "verify", "ask_before")),
)

#: Settings and infrastructure. ``config_only`` rules read settings files, the others code.
SETTINGS = (
    Rule("docker_compose_key", SEC, "Key in a container's settings", 2, r"(?m)^\s*-?\s*(?:OPENAI|ANTHROPIC|HF|GEMINI)_\w*(?:KEY|TOKEN)\s*[=:]\s*[\"']?[A-Za-z0-9_-]{12,}", config_only=True, entropy=True, anchors=("_api_key", "_token", "_key")),
    Rule("terraform_ai_resource", API, "Model service as a resource", 3, r"resource\s+\"(?:azurerm_cognitive_\w+|google_vertex_ai_\w+|aws_sagemaker_\w+|aws_bedrock\w+)\"", config_only=True, anchors=("resource",)),
    Rule("ci_secret_ref", API, "Secret of a pipeline", 4, r"\$\{\{\s*secrets\.(?:OPENAI|ANTHROPIC|HF|GEMINI|COHERE)_\w+\s*\}\}", config_only=True, anchors=("secrets.",)),
    Rule("model_name_in_config", API, "Model named in settings", 4, r"(?im)^\s*[\"']?model(?:_name)?[\"']?\s*[:=]\s*[\"']?(?:gpt-[345]|claude-|gemini-|llama|mistral|mixtral)", config_only=True, anchors=("model",)),
    Rule("aws_cdk_ai", INFRA, "Model service made by code", 3, r"(?i)\b(?:bedrock|sagemaker|comprehend|rekognition)\.(?:Cfn\w+|Function\w*|Client)|aws[-_]cdk[-./\w]*(?:bedrock|sagemaker)|new\s+(?:bedrock|sagemaker)\.", guard=_CLOUD, anchors=("bedrock", "sagemaker", "comprehend", "rekognition")),
    Rule("pulumi_ai", INFRA, "Model service made by Pulumi", 3, r"(?i)type:\s*(?:aws|azure(?:-native)?|gcp):(?:sagemaker|bedrock|cognitive\w*|vertex)\w*", config_only=True, anchors=("type:",)),
    Rule("helm_ai_values", INFRA, "Model in chart values", 3, r"(?im)^\s*(?:modelName|model_name|openai_?key|llm\w*):\s*\S+", config_only=True, path=r"(?:^|/)(?:charts?|helm)/|values[^/]*\.ya?ml$", anchors=("model", "openai", "llm")),
    Rule("ansible_ai", INFRA, "Model library installed by a play", 3, r"(?im)^\s*(?:-\s*)?(?:name|pip|package)?:?\s*[^\n]*\b(?:openai|anthropic|langchain|transformers|vllm|ollama)\b", config_only=True, path=r"(?:^|/)(?:roles|playbooks?|ansible|tasks)/", anchors=("openai", "anthropic", "langchain", "transformers", "vllm", "ollama")),
    Rule("k8s_ai_manifest", INFRA, "Model serving in a manifest", 3, r"(?i)apiVersion:\s*(?:serving\.)?(?:kserve\.io|serving\.knative\.dev|machinelearning\.seldon\.io|ray\.io)/", config_only=True, path=r"(?:^|/)(?:k8s|kubernetes|manifests?|deploy(?:ment)?s?|kustomize)/", anchors=("apiversion",)),
)

GROUPS = {"services": SERVICES, "credentials": CREDENTIALS, "loaders": LOADERS, "prompts": PROMPTS, "agents": AGENTS, "settings": SETTINGS}
ALL = (*RULES, *(r for g in GROUPS.values() for r in g))
