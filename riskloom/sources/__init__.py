"""Reading, writing, column policy and stand-in inputs."""
