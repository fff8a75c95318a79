from siftlight.cli import main

main()
