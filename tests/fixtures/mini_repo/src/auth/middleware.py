from src.config.env import get_env_api_key


def verify_token(token: str) -> bool:
    """Checks a token against the provider key of the environment."""
    return token == get_env_api_key("x")
