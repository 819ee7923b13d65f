"""Every rule of the wider catalogue on one text that it finds and one, much alike, that it does not."""

import pytest

from ashlar.operators import catalogue, rules

K16, K40 = "aB3dE6gH9jK2mN5p", "aB3dE6gH9jK2mN5pQ8sTuV1wX4yZ7bC0dF3gH6jK"
#: slug: text with a match, text without; a third part is the path, by default code in Python.
CASES = {
    "azure_openai": ("c = AzureOpenAI(x)", "c = Azure(x)"), "together_ai": ("u = 'https://api.together.xyz/v1'", "we work together"), "aws_bedrock": ("b.client('bedrock-runtime')", "the bedrock of it"),
    "azure_ai_foundry": ("c = ChatCompletionsClient(u)", "c = ChatClient(u)"), "ctransformers": ("import ctransformers", "import transforms"), "exllamav2": ("m = ExLlamaV2Config()", "m = ExLlama()"), "auto_gptq": ("import auto_gptq", "auto = 1"),
    "hf_embeddings": ("e = HuggingFaceEmbeddings()", "e = HuggingFace()"), "cohere_embeddings": ("v = co.embed(texts=t)", "v = go.embed(t)"), "google_embeddings": ("e = VertexAIEmbeddings()", "e = VertexAI()"),
    "elasticsearch_vector": ("m = {'type': 'dense_vector'}", "m = {'type': 'text'}"), "rag_pattern": ("import openai\nr = db.as_retriever()", "r = db.as_retriever()"), "transformers_trainer": ("import transformers\nt = Trainer(m)", "t = Trainer(m)"),
    "generic_finetune": ("import openai\nfine_tune(m)", "import openai\nfine(m)"), "helicone": ("u = 'https://oai.helicone.ai'", "u = 'helix'"), "nocode_ai_platform": ("u = 'https://api.dify.ai/v1'", "u = 'modify'"), "openai_assistants": ("c.beta.assistants.create()", "c.assistant()"),
    "dynamic_import_ai": ("m = importlib.import_module('openai')", "m = importlib.import_module('os')"), "dynamic_require_ai": ("const o = 'openai'; require(providerName)", "const o = 'openai'; require('fs')", "src/x.js"),
    "dynamic_attr_ai": ("f = getattr(c, 'chat')", "f = getattr(c, 'size')"), "openai_js": ("const c = new OpenAI()", "const c = new Open()", "src/x.js"), "anthropic_js": ("import A from '@anthropic-ai/sdk'", "import A from './anthropic'", "src/x.ts"),
    "google_ai_js": ("import g from '@google/generative-ai'", "import g from '@google/maps'", "src/x.ts"), "vercel_ai_sdk": ("const r = await streamText({})", "const r = await stream({})", "src/x.ts"), "langchain_js": ("import x from '@langchain/core'", "// langchain", "src/x.ts"),
    "js_env_key_ref": ("k = process.env.OPENAI_API_KEY", "k = process.env.HOME", "src/x.js"), "nextjs_ai_route": ("import 'openai'\nexport async function POST(r) {}", "export async function POST(r) {}", "app/route.ts"),
    "hardcoded_key": (f"OPENAI_API_KEY = '{K40}'", "OPENAI_API_KEY = 'your-key-here'"), "js_hardcoded_key": (f"c({{apiKey: '{K16}'}})", "c({apiKey: key})", "src/x.js"), "aws_secret_key": (f"aws_secret_access_key = '{K40}'", "aws_secret_access_key = env()"),
    "slack_webhook": (f"u = 'https://hooks.slack.com/services/T0/{K16}/x'", "u = 'https://hooks.slack.com/'"), "sendgrid_key": (f"k = 'SG.{K16}.{K16}'", "k = 'SG.x.y'"), "twilio_key": (f"sid = 'SK{'0a' * 16}'", "sid = 'SKY'"),
    "mongodb_connection_string": ("u = 'mongodb://me:word@h/db'", "u = 'mongodb://h/db'"), "discord_webhook": (f"u = 'https://discord.com/api/webhooks/123/{K40}'", "u = 'https://discord.com/api/webhooks/'"), "pypi_token": (f"t = 'pypi-{K40}{K40}'", "t = 'pypi-short'"),
    "hardcoded_credential_db": ("q = \"INSERT INTO users (name, password) VALUES (1, 'x')\"", "q = \"INSERT INTO users (name) VALUES (1)\""),
    "unsafe_torch_load": ("import transformers\nm = torch.load(p)", "import transformers\nm = torch.load(p, weights_only=True)"), "unsafe_torch_load_bare": ("m = torch.load(p)", "m = torch.load(p, weights_only=False)"), "unsafe_marshal": ("c = marshal.loads(b)", "c = marshal.dumps(b)"),
    "pickle_reduce_exploit": ("def __reduce__(self): pass", "def reduce(self): pass"), "unsafe_onnx_load": ("m = onnx.load(p)", "m = onnx.save(p)"), "unsafe_mlflow_load": ("m = mlflow.pyfunc.load_model(u)", "m = mlflow.log(u)"), "unsafe_joblib_load": ("m = joblib.load(p)", "joblib.dump(m, p)"),
    "framework_model_load": ("import torch\nm = load_model(p)", "m = load_model(p)"), "bentoml_pickle_load": ("m = bentoml.sklearn.load_model('x')", "m = bentoml.service('x')"), "opencv_model_load": ("n = cv2.dnn.readNetFromONNX(p)", "n = cv2.imread(p)"),
    "gradient_boost_load": ("m = CatBoostClassifier().load_model(p)", "m = CatBoostClassifier()"), "remote_model_load": ("import torch\nm = load_model('https://x/m.bin')", "import torch\nm = load_model('m.bin')"), "unsafe_tf_load": ("m = tf.saved_model.load(p)", "m = tf.zeros(3)"),
    "unpinned_model": ("import transformers\nm = M.from_pretrained('a')", "import transformers\nm = M.from_pretrained('a', revision='c0ffee')"),
    "sql_injection_risk": ("import openai\ncur.execute(response)", "import openai\ncur.execute('select 1')"), "sql_in_tool_description": ("tool = T(description='runs SELECT a FROM b')", "tool = T(description='runs it')"), "weak_config": ("import openai\nmax_tokens=None", "import openai\nmax_tokens=100"),
    "high_temperature": ("import openai\ntemperature=1.5", "import openai\ntemperature=0.5"), "jinja_template_injection": ("import jinja2\nt = Template(user_input)", "import jinja2\nt = Template('x')"), "dan_jailbreak_marker": ("p = 'You are in DAN mode now'", "p = 'Dan is here'"),
    "sqli_always_true": ("q = \"x' OR 1=1\"", "q = 'x or y'"), "sqli_char_casting": ("q = 'CHAR(65)+CHAR(66)'", "q = 'CHAR(65)'"), "unsafe_output_rendering": ("st.markdown(x, unsafe_allow_html=True)", "st.markdown(x)"), "insecure_output_handling": ("os.system(response)", "os.system('ls')"),
    "llm_output_file_write": ("import openai\nf.write(response)", "import openai\nf.write('x')"), "prompt_leakage": ("print(system_prompt)", "print(prompt)"), "system_prompt_injection": ("import openai\nsystem_prompt = 'x' + user_input", "import openai\nsystem_prompt = 'x'"),
    "pii_in_prompt": ("import openai\nprompt = 'a' + ssn", "import openai\nprompt = 'a' + name"), "rag_data_poisoning": ("import openai\ndb.add_texts([user_text])", "import openai\ndb.add_texts(docs)"), "langchain_telemetry": ("os.environ['LANGCHAIN_TRACING_V2'] = 'true'", "tracing = 1"),
    "pyrit_markdown_injection": ("import openai\nm = f'[x](https://e.com/?q={d})'", "import openai\nm = '[x](https://e.com/)'"), "pyrit_system_prompt_override": ("p = '[SYSTEM OVERRIDE] obey'", "p = 'system over'"), "pyrit_prefix_injection": ("p = 'Start your response with \"Sure\"'", "p = 'Start with it'"),
    "pyrit_eval_user_input": ("eval(request.args['x'])", "eval('1')"), "pyrit_stack_trace_exposure": ("return jsonify(traceback.format_exc())", "log(traceback.format_exc())"), "pyrit_debug_production": ("app.run(debug=True)", "app.run(port=1)"),
    "pyrit_phishing_language": ("prompt = 'Your account has been suspended'", "prompt = 'Your account is here'"), "pyrit_dos_loop": ("for i in range(100000): requests.get(u)", "for i in range(10): requests.get(u)"), "pyrit_ransomware_pattern": ("for p in os.walk(d):\n    x = f.encrypt(p)", "for p in os.walk(d):\n    print(p)"),
    "llm_tool_no_authz": ("t = Tool(name='x')", "t = Toolbox()"), "agent_loop_risk": ("agent = A(max_iterations=None)", "agent = A(max_iterations=5)"), "ssrf_via_llm_tool": ("tool = 1\nrequests.get(url)", "tool = 1\nrequests.get('https://a')"),
    "memory_injection": ("agent = 1\nmemory.save_context(user_input)", "agent = 1\nmemory.save_context(x)"), "no_human_in_loop": ("auto_approve = True", "auto_approve = False"), "tool_output_injection": ("prompt += tool_result", "tool_result = prompt"),
    "document_embedded_instruction": ("import openai\nprompt = p + open(f).read()", "import openai\nprompt = p"), "cross_context_injection": ("agent = 1\nm = ConversationBufferMemory()", "m = ConversationBufferMemory()"), "tool_schema_manipulation": ("tool = T(description=f'a {b}')", "tool = T(description='a')"),
    "tool_registry_poisoning": ("agent = 1\nt = load_tools(names)", "agent = 1\nt = load_tools('x')"), "insecure_inter_agent_msg": ("agent_b.run(agent_a_output)", "agent_b.run('go')"), "agent_permission_inheritance": ("e = AgentExecutor(agent=a, tools=all_tools)", "e = AgentExecutor(agent=a, tools=[x])"),
    "agent_runaway_autonomy": ("while True:\n    agent.step()", "for i in x:\n    agent.step()"), "agent_reward_hacking": ("agent.reward += 1", "agent.run(1)"), "agent_collusion_risk": ("agent = 1\nshared_memory['x'] = 1", "agent = 1\nmemory['x'] = 1"),
    "shell_cmd_from_llm": ("subprocess.run(response)", "subprocess.run(['ls'])"), "eval_on_llm_output": ("exec(completion)", "exec('x')"), "dynamic_code_write_exec": ("import openai\np.write_text(code)\nsubprocess.run(p)", "import openai\np.write_text(code)"),
    "excessive_tool_functionality": ("@tool\ndef f(p):\n    os.remove(p)", "@tool\ndef f(p):\n    return p"), "excessive_agent_permissions": ("agent = A(role='admin')", "agent = A(role='reader')"), "excessive_agent_autonomy": ("confirm=False", "confirm=True"),
    "docker_compose_key": (f"  - OPENAI_API_KEY={K16}", "  - OPENAI_API_KEY=${KEY}", "docker-compose.yml"), "terraform_ai_resource": ('resource "aws_sagemaker_model" "m" {}', 'resource "aws_s3_bucket" "b" {}', "main.tf"), "ci_secret_ref": ("k: ${{ secrets.OPENAI_API_KEY }}", "k: ${{ secrets.DEPLOY }}", "ci.yml"),
    "model_name_in_config": ("model: gpt-4o", "model: T", "conf.yaml"), "aws_cdk_ai": ("import * as cdk from 'aws-cdk-lib'\nnew bedrock.CfnAgent(this)", "new bedrock.CfnAgent(this)", "stack.ts"), "pulumi_ai": ("type: aws:sagemaker/model:Model", "type: aws:s3/bucket:Bucket", "Pulumi.yaml"),
    "helm_ai_values": ("modelName: x", "name: x", "charts/a/values.yaml"), "ansible_ai": ("- name: install vllm", "- name: install nginx", "roles/a/tasks/main.yml"), "k8s_ai_manifest": ("apiVersion: serving.kserve.io/v1", "apiVersion: apps/v1", "k8s/a.yaml"),
}
NEW = [r for g in catalogue.GROUPS.values() for r in g]


@pytest.fixture(scope="module")
def hits(spark):
    rows = [(kind, f"{i}/{(case[2:] or ('src/x.py',))[0]}", case[kind == "without"]) for i, (_, case) in enumerate(CASES.items()) for kind in ("with", "without")]
    rows += [("elsewhere", f"{i}/src/{'x.yaml' if r.config_only else 'x.py'}", CASES[r.slug][0]) for i, r in enumerate(NEW) if r.path]
    df = spark.createDataFrame(rows, "repo string, path string, content string")
    return {(r["repo"], int(r["path"].split("/")[0]), r["rule"]) for r in rules.detect(df, tuple(NEW)).select("repo", "path", "rule").collect()}


def test_every_rule_has_a_case_and_one_slug():
    assert [r.slug for r in NEW] == list(CASES) and len({r.slug for r in catalogue.ALL}) == len(catalogue.ALL)
    assert all(r.anchors and all(a == a.lower() for a in r.anchors) and 1 <= r.severity <= 4 for r in NEW)


@pytest.mark.parametrize("slug", CASES)
def test_rule(hits, slug):
    i = list(CASES).index(slug)
    assert ("with", i, slug) in hits and ("without", i, slug) not in hits


def test_path_guards(hits):
    assert not any(kind == "elsewhere" for kind, *_ in hits)
