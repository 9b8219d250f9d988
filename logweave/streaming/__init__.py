"""The normalize jobs on Structured Streaming inputs."""
