"""Plan rules that hold for the engine's operators and that Catalyst cannot know."""
