def get_env_api_key(provider: str) -> str:
    return provider
