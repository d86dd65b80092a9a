"""The model catalogue: fixed values, one row for each model."""

COLUMNS = (
    "model string, provider string, name string, cost_input double, cost_output double, cost_cache_read double, cost_cache_write double, "
    "context_window int, max_output int, supports_tools boolean, supports_vision boolean, supports_reasoning boolean, tier string"
)

# Fixed values, in the order of COLUMNS; costs are in USD per million tokens. The provider is not always the first part of the model's id.
MODELS = [
    ("anthropic/claude-opus-4", "anthropic", "Claude Opus 4", 15.0, 75.0, 1.5, 7.5, 200000, 32000, True, True, True, "premium"),
    ("anthropic/claude-sonnet-4", "anthropic", "Claude Sonnet 4", 3.0, 15.0, 0.3, 7.5, 200000, 32000, True, True, False, "medium"),
    ("anthropic/claude-haiku-4", "anthropic", "Claude Haiku 4", 0.8, 4.0, 0.08, 2.0, 200000, 8192, True, False, False, "budget"),
    ("openai/gpt-5.5", "openai", "GPT-5.5", 5.0, 40.0, 2.5, 10.0, 256000, 16384, True, True, False, "premium"),
    ("openai/gpt-5-mini", "openai", "GPT-5 Mini", 1.0, 8.0, 0.5, 2.0, 256000, 16384, True, True, False, "budget"),
    ("openai/gpt-4o", "openai", "GPT-4o", 2.5, 10.0, 1.25, 5.0, 128000, 16384, True, True, False, "medium"),
    ("deepseek/deepseek-v4-pro", "openai", "DeepSeek V4 Pro", 1.74, 3.48, 0.14, 0.14, 1048576, 384000, True, False, True, "premium"),
    ("deepseek/deepseek-v4-flash", "openai", "DeepSeek V4 Flash", 0.14, 0.28, 0.014, 0.014, 1048576, 384000, True, False, False, "budget"),
    ("deepseek/deepseek-chat", "openai", "DeepSeek V3", 0.29, 0.43, 0.0, 0.0, 65536, 8192, True, False, False, "budget"),
    ("deepseek/deepseek-reasoner", "openai", "DeepSeek R1", 0.55, 2.19, 0.0, 0.0, 65536, 8192, True, False, True, "medium"),
    ("openrouter/anthropic/claude-sonnet-4", "openrouter", "Claude Sonnet 4 (OR)", 3.0, 15.0, 0.0, 0.0, 200000, 32000, True, True, False, "medium"),
    ("openrouter/openai/gpt-4o", "openrouter", "GPT-4o (OR)", 2.5, 10.0, 0.0, 0.0, 128000, 16384, True, True, False, "medium"),
    ("openrouter/google/gemini-2.5-flash", "openrouter", "Gemini 2.5 Flash (OR)", 0.15, 0.60, 0.0, 0.0, 1048576, 8192, True, False, False, "free"),
    ("openrouter/meta-llama/llama-4-maverick", "openrouter", "Llama 4 Maverick (OR)", 0.20, 0.80, 0.0, 0.0, 256000, 8192, True, False, False, "free"),
    ("google/gemini-2.5-pro", "google", "Gemini 2.5 Pro", 1.25, 10.0, 0.0, 0.0, 1048576, 65536, True, True, True, "premium"),
    ("google/gemini-2.5-flash", "google", "Gemini 2.5 Flash", 0.15, 0.60, 0.0, 0.0, 1048576, 8192, True, True, False, "free"),
    ("mistral/mistral-large", "mistral", "Mistral Large", 2.0, 6.0, 0.0, 0.0, 128000, 131072, True, False, False, "medium"),
    ("mistral/mistral-small", "mistral", "Mistral Small", 0.2, 0.6, 0.0, 0.0, 32000, 4096, True, False, False, "budget"),
    ("mistral/codestral", "mistral", "Codestral", 1.0, 3.0, 0.0, 0.0, 256000, 32000, True, False, False, "medium"),
    ("ollama/qwen2.5-coder:7b", "ollama", "Qwen 2.5 Coder 7B", 0.0, 0.0, 0.0, 0.0, 32768, 4096, True, False, False, "free"),
    ("ollama/qwen2.5-coder:14b", "ollama", "Qwen 2.5 Coder 14B", 0.0, 0.0, 0.0, 0.0, 32768, 4096, True, False, False, "free"),
    ("ollama/qwen2.5-coder:32b", "ollama", "Qwen 2.5 Coder 32B", 0.0, 0.0, 0.0, 0.0, 32768, 4096, True, False, False, "free"),
    ("ollama/deepseek-coder-v2", "ollama", "DeepSeek Coder V2", 0.0, 0.0, 0.0, 0.0, 32768, 4096, True, False, False, "free"),
    ("ollama/llama3.1:8b", "ollama", "Llama 3.1 8B", 0.0, 0.0, 0.0, 0.0, 131072, 4096, True, False, False, "free"),
    ("groq/llama-4-scout-17b-16e-instruct", "groq", "Llama 4 Scout 17B", 0.10, 0.40, 0.0, 0.0, 131072, 8192, True, False, False, "free"),
    ("groq/llama-4-maverick-17b-128e-instruct", "groq", "Llama 4 Maverick 17B", 0.20, 0.60, 0.0, 0.0, 131072, 8192, True, False, False, "budget"),
    ("groq/deepseek-r1-distill-llama-70b", "groq", "DeepSeek R1 Distill 70B", 0.75, 0.99, 0.0, 0.0, 131072, 8192, True, False, False, "medium"),
    ("cohere/command-r-plus", "cohere", "Command R+", 2.5, 10.0, 0.0, 0.0, 128000, 4096, True, False, False, "medium"),
    ("cohere/command-r", "cohere", "Command R", 0.5, 1.5, 0.0, 0.0, 128000, 4096, True, False, False, "budget"),
    ("together/meta-llama/Llama-4-Maverick-17B-128E-Instruct-FP8", "together", "Llama 4 Maverick 17B", 0.20, 0.60, 0.0, 0.0, 131072, 4096, True, False, False, "budget"),
    ("together/Qwen/Qwen3-Coder-480B-A35B-Instruct", "together", "Qwen 3 Coder 480B", 1.20, 2.50, 0.0, 0.0, 32768, 8192, True, False, False, "medium"),
    ("together/deepseek-ai/DeepSeek-V3", "together", "DeepSeek V3", 1.25, 1.25, 0.0, 0.0, 65536, 8192, True, False, False, "medium"),
    ("bedrock/anthropic.claude-sonnet-4-20250514-v1:0", "bedrock", "Claude Sonnet 4 (Bedrock)", 3.0, 15.0, 0.0, 0.0, 200000, 32000, True, True, False, "medium"),
    ("bedrock/anthropic.claude-opus-4-20250514-v1:0", "bedrock", "Claude Opus 4 (Bedrock)", 15.0, 75.0, 0.0, 0.0, 200000, 32000, True, True, True, "premium"),
    ("bedrock/meta.llama4-maverick-17b-instruct-v1:0", "bedrock", "Llama 4 Maverick (Bedrock)", 0.30, 0.60, 0.0, 0.0, 131072, 4096, True, False, False, "budget"),
    ("azure/gpt-4o", "azure", "GPT-4o (Azure)", 2.5, 10.0, 0.0, 0.0, 128000, 16384, True, True, False, "medium"),
    ("azure/gpt-4o-mini", "azure", "GPT-4o Mini (Azure)", 0.15, 0.60, 0.0, 0.0, 128000, 16384, True, True, False, "budget"),
]
# End of the fixed values.
